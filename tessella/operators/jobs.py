"""The job queue as batch transforms: statistics, claims, recovery, retries, retention.

The queue is a table of jobs with a status. Each function maps a version of the
table (and a point in time) to rows or to the next version; nothing locks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.values import half_even, retry_delay

TERMINAL = ("completed", "failed", "cancelled", "applied", "rejected")
FINISHED = ("completed", "awaiting_validation", "applied")
COUNTED = ("pending", "running", "failed", "awaiting_validation")


@dataclass(frozen=True)
class JobCols:
    id: str = "id"
    type: str = "type"
    status: str = "status"
    duration: str = "duration_ms"
    created: str = "created_at"
    priority: str = "priority"


def stats(jobs: DataFrame, c: JobCols = JobCols(), finished: tuple[str, ...] = FINISHED) -> DataFrame:
    """Per type: how many jobs of each counted status, and the mean duration of finished jobs (half-even)."""
    counts = [F.sum(F.when(F.col(c.status) == s, 1).otherwise(0)).alias(s) for s in COUNTED]
    mean = F.avg(F.when(F.col(c.status).isin(*finished), F.col(c.duration)))
    return jobs.groupBy(F.col(c.type).alias("type")).agg(*counts, half_even(mean).cast("long").alias("avg_duration"))


def histogram(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Counts per value, 0 for known values that do not occur."""
    spark = rows.sparkSession
    every = spark.range(1).select(F.explode(F.array(*(F.lit(k) for k in known))).alias("value"))
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(every.withColumn("known", F.lit(True))), "value", "full_outer").select("value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def claim(jobs: DataFrame, slots: Column, c: JobCols = JobCols()) -> DataFrame:
    """The jobs to start now: per type the first `slots` by priority, then creation, then id."""
    order = Window.partitionBy(c.type).orderBy(c.priority, c.created, c.id)
    return jobs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= slots)


def free_slots(jobs: DataFrame, config: DataFrame, c: JobCols = JobCols()) -> DataFrame:
    """Per configured type: running jobs and free slots; a limit of null or 0 counts as 1."""
    running = jobs.groupBy(F.col(c.type).alias("type")).agg(F.count_if(F.col(c.status) == "running").alias("running"))
    limits = config.groupBy("type").agg(F.greatest(F.coalesce(F.max("max_concurrent"), F.lit(1)), F.lit(1)).alias("max_concurrent"))
    joined = limits.join(running, "type", "left").select("type", "max_concurrent", F.coalesce("running", F.lit(0)).cast("long").alias("running"))
    return joined.withColumn("free", F.greatest(F.col("max_concurrent") - F.col("running"), F.lit(0)).cast("long"))


def recover_stale(jobs: DataFrame, heartbeat: str, now: Column, minutes: int = 5, status: str = "status") -> DataFrame:
    """Running jobs without a heartbeat in the last minutes go back to pending."""
    old = F.col(heartbeat).isNull() | (F.col(heartbeat) < now - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.withColumn(status, F.when((F.col(status) == "running") & old, "pending").otherwise(F.col(status)))


def plan_retry(jobs: DataFrame, retries: str, most: int, failed_at: str) -> DataFrame:
    """Next state of failed attempts: pending with a time to run again, or failed for good."""
    again = F.col(retries) < most
    delay = F.make_dt_interval(secs=retry_delay(F.col(retries)).cast("decimal(18,6)"))
    return jobs.select("*", F.when(again, "pending").otherwise("failed").alias("next_status"), F.when(again, F.col(failed_at) + delay).alias("scheduled_at"), (F.col(retries) + F.when(again, 1).otherwise(0)).alias("next_retry"))


def purge(jobs: DataFrame, status: str, finished: str, before: Column, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """All but terminal jobs that finished before a time; jobs without an end stay."""
    return jobs.filter(~(F.col(status).isin(*terminal) & F.col(finished).isNotNull() & (F.col(finished) < before)))


def followups(finished: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """Entities to enqueue next: finished ones with no active job for the same keys."""
    return finished.join(active.select(*keys).distinct(), keys, "left_anti")


def latest_progress(events: DataFrame, key: str, value: str, at: str, tie: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(F.col(value), F.struct(at, tie)).alias("progress"), F.max(at).alias("last_at"))


def set_status(jobs: DataFrame, ids: DataFrame, id: str, status: str, allowed: tuple[str, ...], new: str) -> DataFrame:
    """Guarded bulk update: rows named in ids and in an allowed status change; `changed` marks them."""
    named = jobs.join(ids.select(F.col(id)).distinct().withColumn("named", F.lit(True)), id, "left")
    hit = F.coalesce("named", F.lit(False)) & F.col(status).isin(*allowed)
    return named.withColumn("changed", hit).withColumn(status, F.when(F.col("changed"), new).otherwise(F.col(status))).drop("named")

