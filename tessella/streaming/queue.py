"""Structured Streaming twin of the job queue.

Events are (job_id, status, ts). State is kept per job by Spark's state store;
a running job without an event for five minutes of event time is reported stale
and counts as pending again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STALE_MINUTES = 5


def depth(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: events per status in tumbling windows; late events are taken for `late`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A job's newest event counts. Its status is kept until the watermark has passed it, after which no older event is let in; so an event that comes late never revives a job."""
    if state.hasTimedOut:
        status, ts = state.get
        state.remove()
        if status == "running":
            yield pd.DataFrame([(key[0], "pending", ts, True)], columns=["job_id", "status", "ts", "stale"])
        return
    status, ts = state.get if state.exists else (None, None)
    for batch in batches:
        newest = batch.sort_values("ts").iloc[-1]
        if ts is None or newest.ts >= ts:
            status, ts = newest.status, newest.ts
    state.update((status, ts))
    due = int(ts.timestamp() * 1000) + (STALE_MINUTES * 60_000 if status == "running" else 0)
    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs()) + 1)
    yield pd.DataFrame([(key[0], status, ts, False)], columns=["job_id", "status", "ts", "stale"])


def follow(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """job_id, status, ts, stale: the state of each job that had events, and of jobs gone stale."""
    timed = events.select("job_id", "status", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("job_id").applyInPandasWithState(_follow, "job_id string, status string, ts timestamp, stale boolean", "status string, ts timestamp", "append", GroupStateTimeout.EventTimeTimeout)
