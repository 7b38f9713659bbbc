"""Run reports: counters, issues and the exit status of a search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

SUCCESS, PARTIAL, FAILURE = 0, 1, 2


def distinct_issues(issues: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The first issue (by ``at``) of each combination of ``keys``; combined before the shuffle."""
    rest = [c for c in issues.columns if c not in keys and c != at]
    first = issues.groupBy(*keys).agg(F.min(F.struct(at, *rest)).alias("f"))
    return first.select(*keys, f"f.{at}", *[f"f.{c}" for c in rest])


def _status(discovered: Column, failed: Column) -> Column:
    return F.when((discovered > 0) & (discovered == failed), FAILURE).when(failed > 0, PARTIAL).otherwise(SUCCESS).alias("status")


def counts(discovered: DataFrame, matches: DataFrame, issues: DataFrame, by: list[str] | None = None) -> DataFrame:
    """discovered, readable, failed, matches and status, in one row or one per ``by``. ``discovered`` and ``issues`` have full_path.

    This runs the search; ``written`` counts while its matches are written.
    """
    by = by or []
    failed = issues.select("full_path").distinct().withColumn("failed", F.lit(1))
    files = discovered.select(*by, "full_path").distinct().join(failed, "full_path", "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("discovered"), F.count("failed").alias("failed"))
    found = matches.groupBy(*by).agg(F.count(F.lit(1)).alias("matches"))
    # without groups one row each
    both = files.join(found, by, "left") if by else files.join(F.broadcast(found), F.lit(True))
    return both.select(
        *by, "discovered", (F.col("discovered") - F.col("failed")).alias("readable"), "failed", F.coalesce("matches", F.lit(0)).alias("matches"), _status(F.col("discovered"), F.col("failed")))


def written(matches: DataFrame, files: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
    """Run ``write`` on ``matches`` and return the counters of ``counts`` in one row, observed by the write itself.

    ``files``: full_path, cause (null: read), a row per file or issue of it. Matches are counted as they are written, files in one pass of
    their own that runs none of the search. If the write fails, so does this; a part of a write is never counted.
    """
    seen = Observation()
    write(matches.observe(seen, F.count(F.lit(1)).alias("matches")))
    of_file = files.groupBy("full_path").agg(F.count("cause").alias("causes"))
    told = of_file.agg(F.count(F.lit(1)).alias("discovered"), F.count(F.when(F.col("causes") > 0, 1)).alias("failed"))
    return told.select(
        "discovered", (F.col("discovered") - F.col("failed")).alias("readable"), "failed", F.lit(seen.get["matches"]).cast("long").alias("matches"), _status(F.col("discovered"), F.col("failed")))


def per_file(matches: DataFrame) -> DataFrame:
    """Hits by file and sheet."""
    return matches.groupBy("full_path", "sheet_name").agg(F.count(F.lit(1)).alias("hits"), F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"))


def file_sequence(matches: DataFrame) -> DataFrame:
    """For each match its place among those of its file."""
    order = Window.partitionBy("full_path").orderBy("id")
    return matches.withColumn("place", F.row_number().over(order))
