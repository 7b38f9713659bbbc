"""Watching and stopping a search while it runs: its jobs carry a tag."""

from __future__ import annotations

import contextlib

from pyspark.sql import SparkSession


@contextlib.contextmanager
def tagged(spark: SparkSession, tag: str):
    """Jobs that this thread starts inside belong to ``tag``."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> int:
    """Stops the jobs of ``tag``, from any thread; how many there were. What they have written already stays."""
    return len(spark.interruptTag(tag))


def progress(spark: SparkSession) -> tuple[int, int]:
    """(tasks done, tasks known) of the stages that run now; ask as often as the display needs."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s is not None]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
