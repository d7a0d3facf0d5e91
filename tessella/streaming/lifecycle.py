"""Life cycle of jobs as a stream: claims, heartbeats, retries after a pause, stale jobs, saved results.

Events are (job_id, status, ts) with status pending, running (a heartbeat),
failed or completed. Each job is a state with timers in event time:

- pending gives the action `claim`;
- running starts a timer: without a further event for STALE minutes the job is
  `recovered` and claimed again;
- failed starts a timer of BACKOFF seconds (by the number of failures) and is
  claimed again when it ends; after RETRIES it is `dead`;
- completed gives `saved`; the job is over.

An event that is older than the state counts for nothing, so late events don't
revive finished jobs; a finished state is cleared once the watermark has passed
it. Actions are numbered within their job, so equal (job_id, step) are one action.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: Minutes without a heartbeat, pauses in seconds after the first, second and later failures, retries.
STALE_MINUTES, BACKOFF, RETRIES = 5, (60, 300, 900), 3
OVER = ("completed", "dead")
ACTIONS = "job_id string, step int, action string, attempt int, at timestamp"
COLUMNS = ["job_id", "step", "action", "attempt", "at"]


class Job(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, ms long, due long, failures int, step int")

    def _load(self) -> dict:
        names = ("status", "ms", "due", "failures", "step")
        return dict(zip(names, self.state.get() if self.state.exists() else (None, None, None, 0, 0)))

    def _keep(self, job: dict, watermark: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.state.update((job["status"], job["ms"], job["due"], job["failures"], job["step"]))
        if job["due"] is not None:
            self.handle.registerTimer(max(job["due"], watermark) + 1)

    @staticmethod
    def _act(key: tuple, job: dict, action: str, ms: int) -> tuple:
        job["step"] += 1
        return key[0], job["step"], action, job["failures"] + 1, pd.Timestamp(ms, unit="ms")

    def _advance(self, key: tuple, job: dict, ms: int) -> list[tuple]:
        """What has fallen due by then: events and timers take effect in order of time, however they fall into batches."""
        if job["due"] is None or job["due"] > ms or job["status"] in OVER:
            return []
        due, out = job["due"], []
        if job["status"] == "running":
            out.append(self._act(key, job, "recovered", due))
        out.append(self._act(key, job, "claim", due))
        job |= {"status": "pending", "ms": due, "due": None}
        return out

    def _take(self, key: tuple, job: dict, status: str, ms: int) -> list[tuple]:
        """The effect of one event."""
        out = self._advance(key, job, ms)
        if job["ms"] is not None and (ms < job["ms"] or job["status"] in OVER):
            return out
        if status == "pending" and job["status"] is None:
            out.append(self._act(key, job, "claim", ms))
        elif status == "failed":
            job["failures"] += 1
            if job["failures"] > RETRIES:
                status = "dead"
                out.append(self._act(key, job, "dead", ms))
        elif status == "completed":
            out.append(self._act(key, job, "saved", ms))
        pause = {"running": STALE_MINUTES * 60, "failed": BACKOFF[min(max(job["failures"], 1), len(BACKOFF)) - 1], "completed": 0, "dead": 0}.get(status)
        job |= {"status": status, "ms": ms, "due": None if pause is None else ms + pause * 1000}
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 (Spark's names)
        job, out = self._load(), []
        events = pd.concat(list(rows)).sort_values(["ts", "status"])
        for status, ms in zip(events.status, events.ts.astype("datetime64[ms]").astype("int64")):
            out += self._take(key, job, status, int(ms))
        self._keep(job, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        job, out = self._load(), []
        if job["status"] in OVER:
            self.state.clear()
        else:
            out = self._advance(key, job, expiredTimerInfo.getExpiryTimeInMs())
            self._keep(job, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def actions(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """job_id, step, action, attempt, at. Needs the state store of RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    timed = events.select("job_id", "status", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("job_id").transformWithStateInPandas(Job(), ACTIONS, "append", "EventTime")


def save_batches(found: DataFrame, path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] = lambda batch: batch, **trigger) -> StreamingQuery:
    """Starts the stream: each batch is processed and written to its own folder batch=<id>, which a repeated batch replaces. So a restart from the checkpoint saves nothing twice."""

    def save(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return found.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
