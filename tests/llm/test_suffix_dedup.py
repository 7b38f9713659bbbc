import hashlib
import random

from textquarry.llm.suffix_dedup import DEFAULTS, NO_ID, mark_repeats, op1_suffix_dedup, unit_size


def brute(rows, depth=50):
    first = {}
    texts = [(NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - depth + 1):
            s = b[k: k + depth]
            first[s] = min(first.get(s, i), i)
    out = []
    for (i, _), (d, b) in zip(rows, texts):
        gone = bytearray(len(b))
        for k in range(len(b) - depth + 1):
            if first[b[k: k + depth]] < d:
                gone[k: k + depth] = b"\1" * depth
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def check(df, rows, **params):
    got = sorted((tuple(r) for r in mark_repeats(df, **params).collect()), key=repr)
    assert got == brute(rows)
    return got


def planted(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(14) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = [text(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            parts.append(s[rnd.randint(0, 10):] if rnd.random() < 0.5 else s)
            parts.append(text(rnd.randint(0, 12)))
        rows.append((i * 7 % 100, " ".join(parts)))
    rows += [(200 + k, rows[5][1]) for k in range(10)]  # exact copies
    rows += [(300, "a" * 400), (301, "a" * 300 + "b"), (302, "ab" * 200), (303, "ab" * 90)]  # runs of one pattern
    rows += [(310, shared[0]), (310, shared[0] + " tail")]  # one doc_id twice
    rows += [(320, ""), (321, None), (322, "short"), (None, shared[1]), (None, "x" * 60)]
    return rows


def test_as_brute_force(docs_of):
    rows = planted()
    got = check(docs_of(rows), rows)
    assert sum(r[2] for r in got) > 3000


def test_many_units_and_crowded_heads(docs_of):
    rows = planted(4)
    check(docs_of(rows), rows, unit_bytes=1500, many_runs=1)
    check(docs_of(rows), rows, unit_bytes=700, many_runs=64, block_bytes=300)


def test_one_head_with_many_continuations(docs_of):
    rnd = random.Random(5)
    head = "the very same beginning of a line, "
    tails = ["".join(rnd.choice("xyz ") for _ in range(60)) for _ in range(30)]
    rows = [(i, head + tails[i % 30] + head + tails[(i * 7) % 30]) for i in range(80)]
    check(docs_of(rows), rows, unit_bytes=1200, many_runs=3)


def test_long_text_is_cut_into_pieces(docs_of):
    rnd = random.Random(6)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(5 << 20))
    rows = [(1, long), (2, "q" + long[(1 << 20) - 100: (1 << 20) + 100] + "q")]
    got = {r["doc_id"]: r for r in mark_repeats(docs_of(rows)).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["n_spans"]) == (0, 200, 1)


def test_many_rows_of_one_id_and_without_id_spread(docs_of):
    """A third of all rows share a doc_id, a third have none, and their texts are equal: they fill several units all the same."""
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcdefg ") for _ in range(150)) for _ in range(5)]
    rows = [(k, texts[k % 5][:120] + str(k)) for k in range(40)] + [(7, texts[0])] * 40 + [(None, texts[1])] * 40
    df = docs_of(rows)
    check(df, rows, unit_bytes=900)
    assert unit_size(30 * 10**9, DEFAULTS) == 8 << 20 and 100 << 20 < unit_size(10**14, DEFAULTS) < 110 << 20 and unit_size(10**18, DEFAULTS) == 256 << 20
    once = mark_repeats(df, unit_bytes=900)
    once.collect()
    assert once._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2  # the texts are shuffled once


def test_empty_table(empty_docs):
    assert mark_repeats(empty_docs).collect() == []


def test_query_on_tables(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op1_suffix_dedup(spark, small).collect()), key=repr) == brute(rows)
