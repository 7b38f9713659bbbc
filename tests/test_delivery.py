import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from textquarry.operators import units
from textquarry.operators.search import SearchRequest
from textquarry.sinks.export import ExportError
from textquarry.sinks.publish import MANIFEST, manifest_of, publish_parts
from textquarry.streaming import incremental


def add_units(spark, folder, first, n=1):
    rows = [(f"/d/{k}.docx", f"{k}.docx", "Word", 0, False, "word", 1, 0, f"needle {k}", None, None, ["Word"]) for k in range(first, first + n)]
    spark.createDataFrame(rows, units.UNITS).coalesce(1).write.mode("append").parquet(folder)


def found(spark, folder):
    return sorted(int(r["file_name"][:-5]) for r in incremental.kept(spark, folder).collect())


def test_batches_reach_the_caller_and_progress_is_told(spark, tmp_path):
    source, told, seen = f"{tmp_path}/in", [], []
    for k in range(3):
        add_units(spark, source, 10 * k, 2)
    listener = incremental.Progress("three", lambda *x: told.append(x), seconds=0)
    spark.streams.addListener(listener)
    try:
        stream = incremental.search_stream(incremental.arriving_units(spark, source, max_files=1), SearchRequest("NEEDLE"))
        q = incremental.deliver(stream, lambda df, k: seen.append((k, sorted(r["full_content"] for r in df.collect()))), f"{tmp_path}/c", name="three")
        q.awaitTermination(120)
        for _ in range(100):
            if told and told[-1][3]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [k for k, _ in seen] == [0, 1, 2] and sorted(x for _, xs in seen for x in xs) == sorted(f"needle {10 * k + j}" for k in range(3) for j in range(2))
    assert told[-1] == ("three", 3, 6, True) and ("three", 1, 2, False) in told


def test_progress_is_throttled():
    from types import SimpleNamespace as S

    told = []
    p = incremental.Progress("x", lambda *a: told.append(a), seconds=60)
    p.onQueryStarted(S(name="x", runId=1))
    for n in (5, 0, 5, 5):
        p.onQueryProgress(S(progress=S(name="x", numInputRows=n)))
    p.onQueryProgress(S(progress=S(name="other", numInputRows=9)))
    p.onQueryTerminated(S(runId=2))
    p.onQueryTerminated(S(runId=1))
    assert told == [("x", 1, 5, False), ("x", 3, 15, True)]


def test_a_stopped_search_keeps_its_batches_and_goes_on_once(spark, tmp_path):
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c"
    for k in range(4):
        add_units(spark, source, k)
    keep, reached, go = incremental.kept_in(out), threading.Event(), threading.Event()

    def slow(batch, number):
        keep(batch, number)
        if number == 2:  # written, but the batch isn't done yet
            reached.set()
            go.wait(60)

    stream = lambda: incremental.search_stream(incremental.arriving_units(spark, source, max_files=1), SearchRequest("needle"))
    q = incremental.deliver(stream(), slow, checkpoint)
    assert reached.wait(120)
    ended = threading.Thread(target=q.stop)
    ended.start()
    time.sleep(0.5)
    go.set()
    ended.join(60)
    before = found(spark, out)
    assert len(before) in (3, 4) and len(before) == len(set(before))
    add_units(spark, source, 9)
    q = incremental.deliver(stream(), keep, checkpoint)
    q.awaitTermination(120)
    assert found(spark, out) == [0, 1, 2, 3, 9] and incremental.stop(q) >= 4


def test_published_folders_are_whole(spark, tmp_path):
    target = f"{tmp_path}/out"
    df = spark.range(1000).repartition(7)
    told = publish_parts(df, target, inputs=(f"{tmp_path}/in",))
    assert told["rows"] == 1000 and told["parts"] >= 1 and manifest_of(spark, target) == told and spark.read.parquet(target).count() == 1000
    with pytest.raises(ExportError):
        publish_parts(df, target)
    assert manifest_of(spark, target) == told and sorted(os.listdir(tmp_path)) == ["out"]
    told = publish_parts(df.select(F.col("id").cast("string").alias("value")), f"{tmp_path}/lines", lambda d, to: d.write.text(to))
    assert told["rows"] == 1000 and spark.read.text(f"{tmp_path}/lines").count() == 1000


def test_nothing_stays_of_a_failed_write(spark, tmp_path):
    broken = spark.range(100).repartition(5).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken row"))).otherwise(F.col("id").cast("string")).alias("x"))
    with pytest.raises(Exception, match="broken row"):
        publish_parts(broken, f"{tmp_path}/out")
    assert os.listdir(tmp_path) == [] and manifest_of(spark, f"{tmp_path}/out") is None
    assert publish_parts(spark.range(3), f"{tmp_path}/out")["rows"] == 3 and MANIFEST in os.listdir(f"{tmp_path}/out")


@pytest.mark.parametrize("source, target", [("in", "in"), ("in", "in/out"), ("in/deep", "in")])
def test_outputs_are_no_inputs(spark, tmp_path, source, target):
    with pytest.raises(ExportError):
        publish_parts(spark.range(1), f"{tmp_path}/{target}", inputs=(f"{tmp_path}/{source}",))
    assert os.listdir(tmp_path) == []
