"""The pipeline, stage by stage, each against what its operator's own tests hold to be right."""
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from textquarry.llm import common
from textquarry.llm.quality import THRESHOLD, op5_quality_classifier

from test_decontaminate import brute as overlaps
from test_jaccard_join import brute as classes
from test_token_output import library


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [("documents", docs, docs)]
    for name, stage in cp.STAGES:
        got = stage(spark, out[-1][1], small)
        if name != cp.STAGES[-1][0]:
            from textquarry.llm.common import materialize

            got = materialize(got, f"test-{name}")
            assert got.columns == docs.columns
        out.append((name, got, got))
    return {n: (d, d.collect()) for n, d, _ in out}


def test_the_stages_dealt():
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "jaccard_join", "decontamination", "mixing", "token_output"]


def test_quality_keeps_what_scores_enough(spark, small, stages):
    good = {r["doc_id"] for r in op5_quality_classifier(spark, small).where(f"score >= {THRESHOLD}").collect()}
    assert {r["doc_id"] for r in stages["quality_classifier"][1]} == good
    assert 0 < len(good) < len(stages["documents"][1])


def test_one_of_each_near_duplicate_group(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["quality_classifier"][1]]
    assert sorted(r["doc_id"] for r in stages["jaccard_join"][1]) == sorted(i for i, c, _, _ in classes(rows) if i == c)


def test_contaminated_ones_go_and_clean_ones_stay(spark, small, stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["jaccard_join"][1]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = {d for d, *_ in overlaps(rows, items)}
    assert sorted(r["doc_id"] for r in stages["decontamination"][1]) == sorted(d for d, _ in rows if d not in bad)


def test_mix_takes_each_at_most_twice(stages):
    given = {r["doc_id"]: r for r in stages["decontamination"][1]}
    times = {}
    for r in stages["mixing"][1]:
        assert r == given[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) == 2
    size = lambda r: len((r["text"] or "").split())
    total = sum(map(size, given.values()))
    assert 1.3 * total < sum(size(given[i]) * n for i, n in times.items()) < 1.6 * total


def test_written_ids_are_the_mixes(stages):
    tok, start = library(), 0
    got = sorted(map(tuple, stages["token_output"][1]), key=lambda r: r[1])
    want = sorted((r["doc_id"], r["text"]) for r in stages["mixing"][1])
    assert len(got) == len(want)
    for (i, at, n, crc), (doc, text) in zip(got, want):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        assert (i, at, n, crc) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n


def test_runs_again_alike(spark, small):
    rows = lambda: sorted(map(tuple, cp.run(spark, small).collect()))
    assert rows() == rows()


def tables_left(spark):
    import pathlib

    return {p.name.rpartition("-")[0] for p in pathlib.Path(common.stored_dir(spark).removeprefix("file://")).glob("*")}


def test_stages_leave_nothing_behind(spark, small):
    common.clear_stored(spark)
    out = cp.run(spark, small)
    assert tables_left(spark) == {"mixing", "tokens"}  # the last stage's input and files
    assert out.count() > 0
    common.clear_stored(spark)
    assert tables_left(spark) == set()


def odd_docs(docs_of):
    good = "the quick report explains how the harbour was built and what it cost the town over ten years "
    rows = [(k, f"{good} number {k} tells more of it, with {k * 7} ships and {k * 3} sailors who came home", ("a", "b", None)[k % 3]) for k in range(40)]
    rows += [(50, None, "a"), (51, "", "a"), (52, rows[0][1], "b"), (None, rows[1][1], "a"), (None, "a text without an id of its own stays here as it is", "c"),
             (53, "twice the same row in the table of all documents", "a"), (53, "twice the same row in the table of all documents", "a"), (54, "long words " * 100_000, "b"),
             (55, "taken from " + " ".join(f"item{k}" for k in range(20)), "a")]
    return docs_of(rows)


def test_odd_rows_and_clashing_columns_in_every_stage(spark, docs_of, empty_docs, tmp_path):
    docs = odd_docs(docs_of)
    spark.createDataFrame([(k, k % 2, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(20))), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(cp.STAGES)
    count = docs.count()
    for name, _ in cp.STAGES[:-1]:
        got = stages[name](spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        rows = got.collect()
        assert {r["part"] for r in rows} == {"clash part"}
        none = stages[name](spark, empty_docs, str(tmp_path))
        assert none.columns == docs.columns and none.collect() == []
        ids = [r["doc_id"] for r in rows]
        if name == "jaccard_join":
            assert 52 not in ids and ids.count(None) == 1 and ids.count(53) == 1 and {50, 51, 54} <= set(ids)
        if name == "decontamination":
            assert len(rows) == count - 1 and 55 not in ids
    last = stages["token_output"](spark, docs, str(tmp_path))
    assert last.count() == count and stages["token_output"](spark, empty_docs, str(tmp_path)).collect() == []
