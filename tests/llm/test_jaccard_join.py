import random
import re

from textquarry.llm.jaccard_join import drop_near_duplicates, least_equal, near_duplicates, op10_jaccard_join

WORD = re.compile(r"[A-Za-z0-9\x80-\U0010FFFF]+")


def words(t):
    return tuple(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or ""))


def grams(w):
    return {w[i: i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set()


def least(ids):
    return min((i for i in ids if i is not None), default=None)


def brute(rows, t=0.8):
    """(doc_id, class_id, rep, n_links) of every row: classes are told by their words, whatever their ids."""
    ids = {}
    for i, x in rows:
        if words(x):
            ids.setdefault(words(x), []).append(i)
    sets = {w: grams(w) for w in ids}
    root, links = {w: w for w in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for w, g in sets.items():
        for x in g:
            index.setdefault(x, []).append(w)
    done = set()
    for ws in index.values():
        for a in ws:
            for b in ws:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if both >= t * (len(sets[a]) + len(sets[b]) - both):
                        links[a] += 1
                        links[b] += 1
                        root[find(a)] = find(b)
    of = {}
    for w in ids:
        of.setdefault(find(w), []).extend(ids[w])
    out = []
    for i, x in rows:
        w = words(x)
        out.append((i, least(of[find(w)]), least(ids[w]), links[w]) if w else (i, i, i, 0))
    return sorted(out, key=repr)


def planted(seed=2, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(800)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    rows, k = [], 0
    for _ in range(n):
        base = text(rnd.randint(3, 160))
        for _ in range(rnd.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((k, rnd.choice([" ", "  ", ", "]).join(w)))
            k += 1
    rows += [(900, ""), (901, None), (902, "..., !"), (903, "One Two"), (904, "one two"), (905, "one two three")]
    rnd.shuffle(rows)
    return rows


def got(df, **p):
    return sorted((tuple(r) for r in near_duplicates(df, **p).select("doc_id", "class_id", "rep", "n_links").collect()), key=repr)


def test_as_brute_force(docs_of):
    rows = planted()
    want = brute(rows)
    assert sum(1 for r in want if r[3]) > 30
    assert got(docs_of(rows)) == want


def test_one_large_group_in_blocks(docs_of):
    rnd = random.Random(7)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, " ".join(base)) for i in range(40)]
    want = brute(rows)
    assert got(docs_of(rows), block=16) == want
    assert got(docs_of(rows), block_bytes=4096, most_blocks=1) == want
    assert {r[1] for r in want} == {0}


def test_links_of_a_chain_of_edits(docs_of):
    """Copies that drift apart: near the threshold on both sides, so the triangle rule decides some pairs only."""
    rnd = random.Random(11)
    w, rows = [f"c{k}" for k in range(200)], []
    for i in range(120):
        w = list(w)
        w[rnd.randrange(200)] = f"y{i}"
        rows.append((i, " ".join(w)))
    want = brute(rows)
    assert len({r[3] for r in want}) > 5 and {r[1] for r in want} == {0}
    assert got(docs_of(rows), bands=60) == want


def test_patterned_words_are_no_copies(docs_of):
    """Words of a Thue-Morse pattern and their complements differ though many simple hashes can't tell them apart."""
    rows = []
    for k, n in enumerate((256, 1024, 4096)):
        one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        rows += [(2 * k, one), (2 * k + 1, one.translate({97: 98, 98: 97}))]
    assert got(docs_of(rows)) == brute(rows)
    assert drop_near_duplicates(docs_of(rows)).count() == 6


def test_shuffle_joins_instead_of_broadcasts(docs_of):
    rows = planted(8, 20)
    assert got(docs_of(rows), broadcast_rows=1) == brute(rows)


def test_one_of_each_class_stays(docs_of):
    rows = planted(9, 20)
    df = docs_of(rows)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in brute(rows) if r[0] == r[1])


def test_pruning_bound_never_cuts_likely_pairs():
    from math import comb

    for n in (20, 60, 140):
        m = least_equal(0.8, 1e-9, n)
        assert sum(comb(n, k) * 0.8 ** k * 0.2 ** (n - k) for k in range(m)) < 1e-8


def test_repeated_and_null_ids(docs_of):
    text = " ".join(f"w{k}" for k in range(60))
    near = text.replace("w30", "other")
    rows = [(None, text), (7, text), (7, text), (9, text), (None, "other words here"), (None, "other words here"), (3, "one text of the id three"), (3, text + " more"),
            (None, near), (11, "eleven is two"), (11, "different texts"), (12, "twice the same row"), (12, "twice the same row"), (None, None), (None, ""), (13, ""), (13, "")]
    assert got(docs_of(rows)) == brute(rows)
    kept = sorted(((r["doc_id"], r["text"]) for r in drop_near_duplicates(docs_of(rows)).collect()), key=repr)
    assert kept == sorted([(3, text + " more"), (3, "one text of the id three"), (None, "other words here"), (11, "eleven is two"), (11, "different texts"),
                           (12, "twice the same row"), (None, None), (None, ""), (13, ""), (13, "")], key=repr)


def test_a_group_without_ids_keeps_one(docs_of):
    text = [f"n{k}" for k in range(80)]
    rows = [(None, " ".join(text[:40] + [f"z{i}"] + text[41:])) for i in range(6)] * 2 + [(1, "something else here")]
    assert got(docs_of(rows)) == brute(rows)
    assert sorted((r["doc_id"] for r in drop_near_duplicates(docs_of(rows)).collect()), key=repr) == [1, None]


def test_very_long_texts(docs_of):
    rnd = random.Random(5)
    w = [f"q{rnd.randrange(10**6)}" for _ in range(250_000)]
    x = list(w)
    for _ in range(4_000):
        x[rnd.randrange(len(x))] = "edit"
    rows = [(1, " ".join(w)), (2, " ".join(x)), (3, " ".join(w[:150_000])), (4, "short " * 200_000)]
    assert got(docs_of(rows)) == [(1, 1, 1, 1), (2, 1, 2, 1), (3, 3, 3, 0), (4, 4, 4, 0)]


def test_components_of_chains_stars_and_rings(spark, monkeypatch):
    from textquarry.llm import components as c

    rnd = random.Random(4)
    edges, of = [], {}
    for g in range(12):
        ids = rnd.sample(range(g * 1000, g * 1000 + 900), rnd.choice([2, 3, 40, 200]))
        kind = g % 4
        pairs = [(ids[0], x) for x in ids[1:]] if kind == 0 else list(zip(ids, ids[1:])) if kind == 1 else list(zip(ids, ids[1:] + ids[:1])) if kind == 2 else [
            (ids[k], ids[rnd.randrange(k)]) for k in range(1, len(ids))]
        edges += [p if rnd.random() < 0.5 else p[::-1] for p in pairs] + pairs[:1]
        of |= {i: min(ids) for i in ids}
    df = spark.createDataFrame(edges + [(5, 5)], "a long, b long")
    for few in (400_000, 0):
        monkeypatch.setattr(c, "FEW", few)
        assert {r["node"]: r["root"] for r in c.components(df).collect()} == of


def test_empty_table(empty_docs):
    assert near_duplicates(empty_docs).collect() == []
    assert drop_near_duplicates(empty_docs).collect() == []


def test_query_on_tables(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op10_jaccard_join(spark, small).select("doc_id", "class_id", "rep", "n_links").collect()), key=repr) == brute(rows)
