import random
import re

from textquarry.llm.decontaminate import MASKS, ORACLE_SQL, decontaminate, op4_decontamination, overlaps

SPLIT = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return [w for w in SPLIT.split((t or "").lower()) if w]


def short_copies(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            x = words(x)
            at = [k for k in range(len(w) - len(x) + 1) if w[k: k + len(x)] == x] if 1 <= len(x) < 7 else []
            if at:
                old = out.get((d, i), (at[0], len(x)))
                out[d, i] = (min(old[0], at[0]), max(old[1], len(x)))
    return out


def brute(docs, items):
    out = short_copies(docs, items)
    for d, t in docs:
        w = words(t)
        for i, x in {(i, tuple(words(x))) for i, x in items}:
            if len(x) < 7:
                continue
            size = min(13, len(x))
            allowed = 3 if size >= 13 else 2 if size >= 10 else 1
            for shift in range(-len(x), len(w) + 1):
                lo, hi = max(0, -shift), min(len(x), len(w) - shift)
                eq = [w[k + shift] == x[k] for k in range(lo, hi)]
                good = [s for s in range(len(eq) - size + 1) if sum(eq[s: s + size]) >= size - allowed]
                if good:
                    a = (lo + shift + good[0], sum(eq))
                    old = out.get((d, i), a)
                    out[d, i] = (min(old[0], a[0]), max(old[1], a[1]))
    return sorted(((d, i, *v) for (d, i), v in out.items()), key=repr)


def case(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([5, 7, 8, 9, 10, 12, 13, 14, 20, 30])))) for i in range(12)]
    items += [(3, items[3][1]), (50, None), (51, ""), (None, " ".join(vocab[:9]))]
    docs = []
    for d in range(160):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 2)):
            x = words(rnd.choice(items)[1])
            a = rnd.randint(0, 5)
            x = x[a: a + rnd.randint(6, 30)]
            for _ in range(rnd.randint(0, 3)):
                if x:
                    x[rnd.randrange(len(x))] = "Changed"
            at = rnd.randint(0, len(w))
            w[at:at] = x
        docs.append((d, rnd.choice([" ", ", ", "\n"]).join(w).upper() if d % 3 else " ".join(w)))
    docs += [(90, None), (91, ""), (92, items[7][1]), (92, items[8][1]), (None, items[9][1])]
    return docs, items


def bench(spark, items):
    from pyspark.sql import functions as F

    return spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(1).alias("w"), F.lit(2).alias("b"), F.lit(3).alias("seed"))


def test_masks_are_lossless():
    """Every window with the allowed differences holds one seed without any."""
    from itertools import combinations

    for size in range(7, 14):
        allowed = 3 if size >= 13 else 2 if size >= 10 else 1
        for bad in combinations(range(size), allowed):
            assert any(not {p + k for k in m} & set(bad) for m in MASKS for p in range(size - 5)), (size, bad)


def test_as_brute_force(spark, docs_of):
    docs, items = case()
    got = sorted((tuple(r) for r in overlaps(docs_of(docs), bench(spark, items)).collect()), key=repr)
    want = brute(docs, items)
    assert len(want) > 20
    assert got == want


def test_shuffle_joins_give_the_same(spark, docs_of):
    docs, items = case(2)
    got = sorted((tuple(r) for r in overlaps(docs_of(docs), bench(spark, items), broadcast_rows=1).collect()), key=repr)
    assert got == brute(docs, items)


def test_clean_documents_stay(spark, docs_of):
    docs, items = case(3)
    df = docs_of(docs)
    kept = decontaminate(df, bench(spark, items))
    assert kept.columns == df.columns
    bad = {r[0] for r in brute(docs, items)}
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((d for d, _ in docs if d not in bad), key=repr)


def test_short_items_are_found_as_exact_copies(spark, docs_of):
    docs, items = case(4)
    items += [(60, "w1 W2"), (60, "w3"), (61, "w5, w9 w11"), (62, " ".join(f"s{k}" for k in range(6))), (3, "w7")]
    docs += [(200, "before s0 s1 s2 s3 s4 s5 after"), (201, "s0 s1 s2 s3 s4"), (None, "s0 S1 s2-s3 s4 s5"), (202, "s0 s1 s2 changed s4 s5")]
    want = {(d, i): v for d, i, *v in brute(docs, items)}
    assert (200, 62) in want and (None, 62) in want and (201, 62) not in want
    for rows in (1_000_000, 1):
        got = overlaps(docs_of(docs), bench(spark, items), broadcast_rows=rows).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(((*k, *v) for k, v in want.items()), key=repr)
    kept = decontaminate(docs_of(docs), bench(spark, items[-2:-1]))
    assert {200, None} & {r["doc_id"] for r in kept.collect()} == set()


def test_short_items_as_sql(spark, docs_of, same_as_sql, tmp_path):
    docs, items = case(6)
    items += [(60, "w1 W2"), (61, "w5, w9 w11"), (3, "w7")]
    for name, df in (("documents", docs_of([r for r in docs if r[0] is not None], False)), ("benchmark", bench(spark, [r for r in items if r[0] is not None]))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        (tmp_path / f"{name}.parquet").write_bytes(next((tmp_path / name).glob("*.parquet")).read_bytes())
    same_as_sql(op4_decontamination, ORACLE_SQL["op4_decontamination"], str(tmp_path))


def test_very_long_texts(spark, docs_of):
    rnd = random.Random(1)
    item = " ".join(f"i{k}" for k in range(20))
    docs = [(1, " ".join(f"v{rnd.randrange(50)}" for _ in range(150_000)) + " " + item), (2, "v1 " * 150_000)]
    assert [tuple(r) for r in overlaps(docs_of(docs), bench(spark, [(7, item)])).collect()] == [(1, 7, 150_000, 20)]


def test_empty_tables(spark, docs_of, empty_docs):
    docs, items = case()
    assert overlaps(empty_docs, bench(spark, items)).collect() == []
    assert overlaps(docs_of(docs), bench(spark, items).limit(0)).collect() == []
    assert decontaminate(docs_of(docs), bench(spark, items).limit(0)).count() == len(docs)


def test_no_python_in_the_plan(spark, small):
    plan = op4_decontamination(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_as_sql(same_as_sql, medium):
    same_as_sql(op4_decontamination, ORACLE_SQL["op4_decontamination"], medium)
