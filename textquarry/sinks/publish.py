"""Publishing of results that many tasks write: all of a folder or nothing of it, with a manifest, never over something else.

Tasks write to a folder beside the target, by Spark's own writers and committers, so attempts that fail or run twice leave nothing. When
the write has succeeded the manifest is added and the folder gets the target's name in one rename (one step on file systems that
have one; an object store copies, so there the manifest, which is written last, says that a folder is complete).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textquarry.sinks.export import ExportError

MANIFEST = "_manifest.json"


def _path(spark: SparkSession, path: str):
    """(file system, full path) of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def _inside(a: str, b: str) -> bool:
    return a == b or a.startswith(b.rstrip("/") + "/")


def publish_parts(df: DataFrame, target: str, write: Callable[[DataFrame, str], None] | None = None, inputs: tuple[str, ...] = ()) -> dict:
    """Write ``df`` with ``write`` (default: Parquet) and publish it as the folder ``target``; its manifest.

    ExportError if the target exists, or lies in one of ``inputs`` or the other way round. The manifest has the number of rows, counted
    by the write itself, and of parts and their bytes.
    """
    spark = df.sparkSession
    fs, goal = _path(spark, target)
    full = goal.toString()
    for i in inputs:
        other = _path(spark, i)[1].toString()
        if _inside(full, other) or _inside(other, full):
            raise ExportError(f"the output is an input, or one lies in the other: {target}")
    if fs.exists(goal):
        raise ExportError(f"the output exists: {target}")
    stage = f"{goal.getParent().toString().rstrip('/')}/.{goal.getName()}-{uuid.uuid4().hex}"
    at = _path(spark, stage)[1]
    seen = Observation()
    try:
        (write or (lambda d, to: d.write.parquet(to)))(df.observe(seen, F.count(F.lit(1)).alias("rows")), stage)
        parts = [s for s in fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))]
        manifest = {"rows": seen.get["rows"], "parts": len(parts), "bytes": sum(s.getLen() for s in parts)}
        out = fs.create(_path(spark, f"{stage}/{MANIFEST}")[1], False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        # someone else may have made it meanwhile: a rename onto a folder would move into it
        if fs.exists(goal) or not fs.rename(at, goal):
            raise ExportError(f"the output exists: {target}")
        return manifest
    finally:
        fs.delete(at, True)


def manifest_of(spark: SparkSession, target: str) -> dict | None:
    """The manifest of a published folder; None if it isn't complete."""
    fs, at = _path(spark, f"{target.rstrip('/')}/{MANIFEST}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
