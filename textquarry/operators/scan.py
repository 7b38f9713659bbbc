"""Running sums, maxima and last values along a global order, where one group may hold most of the rows.

A window over a group puts the whole group into one task. Here the rows are dealt by ranges of (group, order) instead, so
a large group lies in many parts; each part is scanned by itself, and one row per part carries what came before it into the
group that it continues (a two-level prefix scan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators.storage import stored

_COMBINE = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def with_row_ids(df: DataFrame, column: str) -> DataFrame:
    """``df`` stored with a number per row that stays what it is, whatever is computed again; numbers differ, but leave gaps."""
    return stored(df.withColumn(column, F.monotonically_increasing_id()), "rows")


def running(df: DataFrame, group: list[str], order: list[str], values: dict[str, tuple[str, Column]], keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns) of ``df`` and, for each of ``values`` (name: (kind, column)), the sum, max or last non-null
    value of the column over the rows of its group up to and with this row.

    ``group`` may be empty: one group of all rows. Nulls in a group's columns form groups like other values, nulls in
    ``order`` come first. Rows that are equal in group and order follow one another in no fixed order and in one part, so a
    unique last column of ``order`` keeps parts even whatever repeats. ``df`` is read twice (bounds of the ranges are
    sampled first); what is stored are the kept columns, the group's and the values'.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    names = {name: f"_value{k}" for k, name in enumerate(values)}
    groups = {g: f"_group{k}" for k, g in enumerate(group)}
    at = [F.col(c) for c in (*group, *order)] or [F.lit(0)]
    dealt = df.repartitionByRange(n, *at).sortWithinPartitions(*at).select(
        *[F.col(c) for c in (df.columns if keep is None else keep)], *[F.col(g).alias(x) for g, x in groups.items()],
        *[column.alias(names[name]) for name, (_, column) in values.items()],
        F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    dealt = stored(dealt, "dealt")
    here = F.struct(F.lit(0).alias("_"), *groups.values())

    # one row per part: its first and last group, and the values of the last group's rows in it
    edges = dealt.groupBy("_part").agg(F.min_by(here, "_at").alias("_first"), F.max_by(here, "_at").alias("_last"))
    # as many rows as parts, each with the columns of one group
    ends = dealt.join(F.broadcast(edges.select("_part", "_last")), "_part").where(here.eqNullSafe(F.col("_last")))
    totals = ends.groupBy("_part").agg(*[
        (F.max_by(names[name], F.when(F.col(names[name]).isNotNull(), F.col("_at"))) if kind == "last" else _COMBINE[kind](names[name])).alias(names[name])
        for name, (kind, _) in values.items()])
    parts = edges.join(totals, "_part")
    so_far = Window.partitionBy("_last").orderBy("_part")
    before = Window.orderBy("_part")  # as many rows as parts
    parts = parts.select("_part", "_first", "_last", *[_COMBINE[kind](names[name]).over(so_far).alias(names[name]) for name, (kind, _) in values.items()])
    parts = parts.select("_part", "_first", F.lag("_last").over(before).alias("_previous"), *[F.lag(x).over(before).alias(x) for x in names.values()])
    carried = parts.where(F.col("_previous").eqNullSafe(F.col("_first"))).select(
        "_part", F.lit(-1).cast("long").alias("_at"), *[F.col(f"_first.{x}").alias(x) for x in groups.values()], *names.values())

    along = Window.partitionBy("_part", *groups.values()).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.unionByName(carried, allowMissingColumns=True)
    over = [_COMBINE[kind](names[name]).over(along).alias(f"{names[name]}_") for name, (kind, _) in values.items()]
    kept = [c for c in dealt.columns if c not in {*groups.values(), *names.values(), "_part", "_at"}]
    return rows.select("*", *over).where(F.col("_at") >= 0).select(*kept, *[F.col(f"{x}_").alias(name) for name, x in names.items()])
