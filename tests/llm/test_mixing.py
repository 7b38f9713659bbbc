import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm.mixing import flight, land, mix, mix_decisions, op3_mixing, targets

P = {"weights": (3.0, 1.0, 2.0), "share": 1.5, "most": 2.0}


def table_of(seed=1, n=3000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choices(["a", "b", "c", "d", None], [60, 20, 10, 9, 1])[0]
        rows.append((i, " ".join(["w"] * int(rnd.paretovariate(0.9) % 4000)), source))
    return rows


def test_targets_stop_at_twice_a_source_and_reshare():
    got = targets({"b": 100, "a": 100, "c": 1000, None: 10}, P)
    assert list(got) != [] and abs(sum(got.values()) - 1815) < 1e-6  # weights a 3, b 1, c 2, null 3
    assert got["a"] == 200 and got[None] == 20 and got["b"] == 200 and abs(got["c"] - 1395) < 1e-9
    assert targets({}, P) == {}
    assert set(targets({"a": 0, "b": 0}, P).values()) == {0.0}


def test_each_source_comes_near_its_target(docs_of):
    rows = table_of()
    got = mix_decisions(docs_of(rows), block_rows=200, hold=20).collect()
    assert len(got) == len(rows)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    by, counts = {}, {}
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and r["copies"] in (0, 1, 2)
        by.setdefault(r["source"], []).append(r)
    for s, rs in by.items():
        total = sum(r["size"] for r in rs)
        assert all(r["source_size"] == total for r in rs)
        small = sorted(r["size"] for r in rs)
        assert abs(sum(r["copies"] * r["size"] for r in rs) - rs[0]["target"]) <= small[len(small) // 2] + 2, s
        counts[s] = (sum(r["copies"] for r in rs), rs[0]["target"] / max(1, total) * len(rs))
    assert all(abs(a - b) < 40 for a, b in counts.values()), counts
    again = mix_decisions(docs_of(random.Random(3).sample(rows, len(rows))).repartition(7), block_rows=200, hold=20).collect()
    assert {r["doc_id"]: r["copies"] for r in again} == {r["doc_id"]: r["copies"] for r in got}


def test_more_sources_than_the_bound_give_the_same(docs_of):
    rnd = random.Random(7)
    names = [f"host{k}.\u00e9" if k % 5 else f"\U0001f600{k}" for k in range(40)] + ["", None, "empty"]
    rows = [(i, "" if s == "empty" else "w " * rnd.randint(1, 30), s) for i, s in enumerate(rnd.choices(names, [1 / (k + 1) for k in range(len(names))], k=3000))]
    docs = docs_of(rows)
    few = {r["doc_id"]: r for r in mix_decisions(docs).collect()}
    assert len({(r["source"], r["target"]) for r in few.values()}) > 35
    for bound in (5, 1):
        many = mix_decisions(docs, max_sources=bound)
        got = many.collect()
        assert len(got) == len(rows)
        for r in got:
            q = few[r["doc_id"]]
            assert (r["source"], r["size"], r["source_size"]) == (q["source"], q["size"], q["source_size"])
            assert abs(r["target"] - q["target"]) < 1e-6 * max(1, q["target"])
        words = {}
        for r in got:
            words[r["source"]] = words.get(r["source"], 0) + r["copies"] * r["size"]
        assert all(abs(words[r["source"]] - r["target"]) <= 31 for r in got)


def test_a_table_of_sources_fills_up_in_rounds(spark):
    sizes = {f"s{k:03}": (k * 37) % 91 * (1 + k % 7) ** 3 for k in range(200)} | {None: 5}
    from textquarry.llm.mixing import DEFAULTS, _by_table

    table = spark.createDataFrame([(s, v, 1) for s, v in sizes.items()], "source string, size long, n long")
    for most in (2.0, 1.6, 1.5):
        want = targets(sizes, DEFAULTS | {"most": most})
        got = {r["source"]: r["target"] for r in _by_table(table, DEFAULTS | {"most": most}).collect()}
        assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_more_rounds_of_blocks(docs_of):
    rows = [(i, "w " * (i % 13 + 1), "s" if i % 3 else "t") for i in range(600)]
    got = mix_decisions(docs_of(rows), block_rows=40, hold=8).collect()
    for s in ("s", "t"):
        rs = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in rs) - rs[0]["target"]) <= 14


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 500)), max_size=60), st.integers(0, 1000))
def test_flight_keeps_both_totals(entries, seed):
    p, x = np.array([e[0] for e in entries]), np.array([e[1] for e in entries], float)
    rng = np.random.default_rng(seed)
    out = flight(p, x, rng)
    assert abs(out.sum() - p.sum()) < 1e-4 and abs((out * x).sum() - (p * x).sum()) < 1e-4 * max(1, x.sum())
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert set(land(p, x, rng)) <= {0.0, 1.0}


def test_inclusion_probabilities_are_kept():
    rng = np.random.default_rng(1)
    p, x = rng.random(12), rng.integers(1, 50, 12).astype(float)
    mean = np.mean([flight(p, x, rng) for _ in range(8000)], axis=0)
    assert np.abs(mean - p).max() < 0.025


def test_rows_come_as_often_as_taken(docs_of):
    rows = table_of(5, 400) + [(9001, None, "a"), (9001, "x y", "a"), (9002, "", None), (None, "null id", "b"), (None, "null id", "b"), (None, "null id", "b"), (3, "other text", "a")]
    df = docs_of(rows)
    out = mix(df)
    assert out.columns == df.columns
    key = lambda r: (r["doc_id"], r["source"], r["size"])
    times, taken = {}, {}
    for r in out.collect():
        k = (r["doc_id"], r["source"], len((r["text"] or "").split()))
        times[k] = times.get(k, 0) + 1
        assert r["_k"] == "clash _k"
    for r in mix_decisions(df).collect():
        taken[key(r)] = taken.get(key(r), 0) + r["copies"]
    assert times == {k: n for k, n in taken.items() if n}


def test_null_and_shared_ids_are_documents_of_their_own(docs_of):
    """A third of the rows without id, an id that many share, equal rows: a row each, near the target."""
    rnd = random.Random(4)
    text = lambda: "w " * rnd.randint(1, 40)
    rows = [(None, text(), rnd.choice("ab")) for _ in range(500)] + [(7, text(), rnd.choice("ab")) for _ in range(300)] + [(100 + k, text(), rnd.choice("abc")) for k in range(600)]
    rows += [(8, "same words here", "a")] * 101
    got = mix_decisions(docs_of(rows), block_rows=100, hold=10).collect()
    want, found = {}, {}
    for i, t, s in rows:
        want[i, s, len(t.split())] = want.get((i, s, len(t.split())), 0) + 1
    for r in got:
        found[r["doc_id"], r["source"], r["size"]] = found.get((r["doc_id"], r["source"], r["size"]), 0) + 1
        assert 0 <= r["copies"] <= 2
    assert found == want
    for s in "abc":
        rs = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in rs) - rs[0]["target"]) <= 3
        assert abs(sum(r["copies"] for r in rs) - rs[0]["target"] / rs[0]["source_size"] * len(rs)) < 30
    equal = [r["copies"] for r in got if r["doc_id"] == 8]
    assert max(equal) - min(equal) <= 1


def test_empty_and_wordless(docs_of, empty_docs):
    assert mix_decisions(empty_docs).collect() == []
    assert mix(empty_docs).collect() == []
    got = mix_decisions(docs_of([(1, None, "a"), (2, "", "b")])).collect()
    assert all(r["copies"] * r["size"] == 0 and r["target"] == 0 for r in got) and len(got) == 2


def test_query_on_tables(spark, medium):
    got = op3_mixing(spark, medium).toPandas()
    assert len(got) == spark.read.parquet(f"{medium}/documents.parquet").count()
    assert (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby(["source_size", "target"]):
        assert abs(g.taken.sum() - g.target.iloc[0]) < 0.001 * g.target.iloc[0] + 5
