"""Cutting lineage through the folder that driver and executors share, and numbering rows in a global order."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session on one machine can do without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/textquarry-shared"
    return path.rstrip("/")


def stored_dir(spark: SparkSession) -> str:
    """The folder of what this application stores."""
    return f"{shared_dir(spark)}/textquarry-{spark.sparkContext.applicationId}"


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SCOPES: list[list[tuple[SparkSession, str]]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends at files that every executor can read.

    ``discard`` removes one such table, ``clear_stored`` all of the application, ``scratch`` those of a block of code.
    """
    spark = df.sparkSession
    path = f"{stored_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    for scope in _SCOPES:
        scope.append((spark, path))
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Remove tables that ``stored`` returned, once nothing is read from them any more."""
    for df in frames:
        path = _PATHS.pop(df, None)
        if path:
            _remove(df.sparkSession, path)


def clear_stored(spark: SparkSession) -> None:
    """Remove everything that this application has stored; results that are still to be computed can't be any more."""
    _remove(spark, stored_dir(spark))


@contextlib.contextmanager
def scratch():
    """All that is stored inside goes at the end, but the tables of frames appended to the list that it gives."""
    made: list[tuple[SparkSession, str]] = []
    kept: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield kept
    finally:
        _SCOPES.remove(made)
        stay = {_PATHS.get(df) for df in kept}
        for spark, path in made:
            if path not in stay:
                _remove(spark, path)


def number_rows(df: DataFrame, order: list[Column | str], column: str = "id") -> DataFrame:
    """``df`` with 1..N in ``order`` as ``column``, without bringing all rows to one task.

    The rows are stored first, since a range shuffle reads its input twice (it samples); then it sorts, each partition numbers its own rows; the partitions' counts (one small row each) give the offsets.
    Only the sorted rows stay stored.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    unnumbered = stored(df, "unnumbered")
    dealt = unnumbered.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    discard(unnumbered)
    counts = sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for part, rows in counts:
        offsets.append((part, total))
        total += rows
    table = spark.createDataFrame(offsets or [(0, 0)], "_part int, _before long")
    # one row per shuffle partition
    return dealt.join(F.broadcast(table), "_part").withColumn(
        column, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")
