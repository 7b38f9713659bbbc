"""Listing of folders as a Spark job: every round lists the folders that the last one found, some in each task.

Folders that the filter ignores are never entered, links are not followed, names that start with ``_`` or ``.`` count like others, and a
folder that can't be read is a row with its cause. Each row has the device and the inode, by which files that are named twice are told.
Folders must be readable under their paths on every executor (local or mounted storage). Each round's rows are stored, so that a lost
executor costs one round's share at most; a tree of depth d takes d rounds, and only counts come to the driver.
"""

from __future__ import annotations

import os
import stat
from datetime import UTC, datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.patterns import PathFilter
from textquarry.operators.shipping import ship_package
from textquarry.operators.storage import stored

LISTED = T.StructType([T.StructField(name, kind) for name, kind in (
    ("root", T.StringType()), ("relative_path", T.StringType()), ("full_path", T.StringType()), ("kind", T.StringType()), ("explicit", T.BooleanType()), ("size", T.LongType()),
    ("modified", T.TimestampType()), ("device", T.LongType()), ("inode", T.LongType()), ("cause", T.StringType()))])
_NAMES = LISTED.names


def _entry(root: str, relative: str, full: str, explicit: bool = False) -> tuple | None:
    """The row of what lies at ``full``; None for a link (unless it was named explicitly) and for what is neither file nor folder."""
    try:
        s = os.stat(full) if explicit else os.lstat(full)
    except OSError as e:
        return (root, relative, full, "issue", explicit, None, None, None, None, e.strerror or str(e))
    kind = "folder" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else None
    # device and inode numbers may have the highest bit set
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    return kind and (root, relative, full, kind, explicit, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC), signed(s.st_dev), signed(s.st_ino), None)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=_NAMES)


def _list_folders(batches):
    """Entries of the folders (root, relative_path, full_path) of each batch, in pieces."""
    for b in batches:
        out = []
        for root, relative, full in zip(*[b.column(k).to_pylist() for k in range(3)]):
            try:
                with os.scandir(full) as found:
                    for e in found:
                        row = _entry(root, f"{relative}/{e.name}" if relative else e.name, e.path)
                        out += [row] if row else []
                        if len(out) >= 10_000:
                            yield _rows(out)
                            out = []
            except OSError as e:
                out.append((root, relative, full, "issue", False, None, None, None, None, e.strerror or str(e)))
        yield _rows(out)


def list_tree(spark: SparkSession, roots: list[str], wanted: PathFilter | None = None) -> DataFrame:
    """Files and issues below ``roots`` (folders, or files named explicitly; none inside another).

    Files pass extension, include and ignore patterns of ``wanted`` and the test for lock files; an explicitly named one is not tested for
    being a lock file. A root that is missing is an issue.
    """
    ship_package(spark)
    named = [os.path.abspath(os.path.expanduser(r)) for r in dict.fromkeys(roots)]
    given = [_entry(r, "" if os.path.isdir(r) else os.path.basename(r), r, True) for r in named]
    at = stored(spark.createDataFrame([x for x in given if x], LISTED), "listed")
    rounds = [at.where("kind <> 'folder'")]
    folders = at.where("kind = 'folder'")
    n = max(1, spark.sparkContext.defaultParallelism * 4)
    while folders.limit(1).count():
        dealt = folders.select("root", "relative_path", "full_path").repartition(n, "full_path")
        found = stored(dealt.mapInArrow(_list_folders, LISTED), "listed")
        rounds.append(found.where("kind <> 'folder'"))
        folders = found.where("kind = 'folder'")
        if wanted is not None:
            folders = folders.where(~wanted.decided(F.col("relative_path"), True))  # nothing below an ignored folder is found
    out = reduce(DataFrame.unionByName, rounds)
    if wanted is None:
        return out
    path = F.col("relative_path")
    lock = F.substring_index(path, "/", -1).startswith("~$")
    # folders above have been decided
    keeps = (F.col("explicit") | ~lock) & wanted.included(path) & ~wanted.decided(path, False)
    return out.where((F.col("kind") == "issue") | keeps)


def distinct_files(listed: DataFrame) -> DataFrame:
    """One row per file, the first by path, however many names (hard links) lead to it; issues stay."""
    files = listed.where("kind = 'file'")
    first = files.groupBy("device", "inode").agg(F.min(F.struct("full_path", *[c for c in _NAMES if c not in ("full_path", "device", "inode")])).alias("f"))
    return first.select("device", "inode", "f.*").select(*_NAMES).unionByName(listed.where("kind <> 'file'"))
