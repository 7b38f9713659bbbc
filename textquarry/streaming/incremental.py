"""Incremental search: units that arrive as files are searched once each, in micro-batches, and handed to a caller or kept in a folder.

A search that is stopped keeps the batches it had completed; started again with its checkpoint it goes on with the next one. A batch that
was under way is handed over again under the same number, so a receiver that keeps one result per number has each match once.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from textquarry.operators.search import SearchRequest, hits, project
from textquarry.operators.units import UNITS


def arriving_units(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of units from Parquet files of that schema; ``max_files`` per batch bounds its size."""
    return spark.readStream.schema(UNITS).option("maxFilesPerTrigger", max_files).parquet(folder)


def match_key(df: DataFrame) -> DataFrame:
    """``df`` with a key that is the same whenever the same unit matches again."""
    return df.withColumn("match_key", F.xxhash64("full_path", "sheet_name", "match_type", "row_index", "col_index", "shape_name", "full_content"))


def search_stream(units: DataFrame, request: SearchRequest, distinct: bool = True, within: str | None = None) -> DataFrame:
    """Matches of a stream; ``distinct`` keeps one of matches that come again.

    Its state is one key per match; with ``within`` (as "1 day") a key is forgotten that long after the match was first seen,
    so that the state is that of the matches of such a time.
    """
    found = match_key(project(hits(units, request)).drop("sheet_pos", "kind_pos"))
    if not distinct:
        return found
    if within is None:
        return found.dropDuplicates(["match_key"])
    return found.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", within).dropDuplicatesWithinWatermark(["match_key"]).drop("seen_at")


def write_matches(matches: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append matches to a Parquet folder; the checkpoint makes a restart go on where it stopped."""
    out = matches.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="1 second")).start()


def deliver(matches: DataFrame, give: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, name: str | None = None) -> StreamingQuery:
    """Hand each batch of matches to ``give`` with its number, as a DataFrame: nothing is collected unless the receiver does so."""
    out = matches.writeStream.foreachBatch(give).option("checkpointLocation", checkpoint).outputMode("append")
    out = out.queryName(name) if name else out
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="1 second")).start()


def kept_in(folder: str) -> Callable[[DataFrame, int], None]:
    """A receiver that keeps each batch under its number in a Parquet folder: one that comes again replaces itself."""

    def give(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return give


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """All matches that ``kept_in`` has kept, with the number of their batch."""
    return spark.read.parquet(folder)


class Progress(StreamingQueryListener):
    """Tells ``tell`` (name, batches done, units read, whether it has ended) of the queries of a name, at most every ``seconds``, and at the end."""

    def __init__(self, name: str, tell: Callable[[str, int, int, bool], None], seconds: float = 0.2):
        self.name, self.tell, self.seconds = name, tell, seconds
        self.batches, self.units, self.last, self.run = 0, 0, 0.0, None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name != self.name or not p.numInputRows:
            return
        self.batches, self.units = self.batches + 1, self.units + p.numInputRows
        if time.monotonic() - self.last >= self.seconds:
            self.last = time.monotonic()
            self.tell(self.name, self.batches, self.units, False)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.runId == self.run:
            self.tell(self.name, self.batches, self.units, True)


def stop(query: StreamingQuery) -> int:
    """Ends a search; the number of batches that it has completed, which stay and are not searched again."""
    query.stop()
    last = query.lastProgress
    return 0 if last is None else last["batchId"] + 1
