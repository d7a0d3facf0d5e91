"""Distributions, rates, verdicts and tag counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.values import half_even
from tessella.operators import ranges

#: Fixed value: largest defect rate of a passed gate.
GATE = 0.30


def order_statistics(rows: DataFrame, by: str, value: str, **ranks: Column) -> DataFrame:
    """Per group n and the values at ranks (from 0, columns of n) in ascending order, exact; null where a rank is out of range.

    Equal values are counted before the shuffle. The counts are split into ranges
    of values, many for a large group; only the ranges in which a rank falls are
    counted through, so no group passes through one task.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("__c"))
    totals = counts.groupBy(by).agg(F.sum("__c").alias("n"))
    ranged = ranges.in_ranges(counts, [by], [value])
    parts = ranges.before(ranged, [by], F.col("__c")).join(totals, by)
    inside = lambda rank: (rank >= F.col("__before")) & (rank < F.col("__before") + F.col("__inside"))
    wanted = parts.filter(reduce(lambda a, b: a | b, map(inside, ranks.values())))
    upto = F.sum("__c").over(Window.partitionBy(by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.join(wanted, [by, "__range"]).withColumn("__upto", F.col("__before") + upto)
    found = placed.groupBy(by).agg(*(F.min(F.when((rank >= F.col("__before")) & (rank < F.col("__before") + F.col("__inside")) & (F.col("__upto") > rank), F.col(value))).alias(name) for name, rank in ranks.items()))
    return totals.join(found, by, "left")


def distribution(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Per group: n, smallest, upper median, element at int(0.9 n), largest. The order statistics are exact."""
    n = F.col("n")
    return order_statistics(rows, by, value, min=F.lit(0), median=F.floor(n / 2), p90=F.floor(n * F.lit(0.9)), max=n - 1).select(by, "n", "min", "median", "p90", "max")


def latency(rows: DataFrame, by: str, value: str, ok: Column, budget: float) -> DataFrame:
    """Statistics over successful rows, rates over all of them."""
    judged = rows.withColumn("__ok", ok)
    sums = judged.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if("__ok").alias("n_ok"),
        half_even(F.avg(F.when(F.col("__ok"), F.col(value))), 4).alias("mean"),
        half_even(F.count_if(F.col("__ok") & (F.col(value) <= budget)) / F.count("*"), 4).alias("within_budget"),
        half_even(F.count_if(F.col("__ok") & (F.col(value) > budget)) / F.count("*"), 4).alias("over_budget"),
    )
    n = F.col("n")
    ranks = order_statistics(judged.filter("__ok"), by, value, low=F.floor((n - 1) / 2), high=F.floor(n / 2), p95=F.bround(F.lit(0.95) * (n - 1), 0)).drop("n")
    return sums.join(ranks, by, "left").select(by, "n", "n_ok", half_even((F.col("low") + F.col("high")) / 2, 4).alias("median"), "p95", "mean", "within_budget", "over_budget")


def defect_rates(rows: DataFrame, by: str, scored: Column, a: Column, b: Column, least: int = 1) -> DataFrame:
    """Over scored rows: n, the two defect counts and (a + b) / 2n; null where n is 0. With the gate's verdict: waiting without rows, info under `least` rows, else go or no_go."""
    sums = rows.groupBy(by).agg(F.count_if(scored).alias("n"), F.count_if(scored & a).alias("n_a"), F.count_if(scored & b).alias("n_b"))
    rate = F.when(F.col("n") > 0, half_even((F.col("n_a") + F.col("n_b")) / (2 * F.col("n")), 4))
    return sums.withColumn("rate", rate).withColumn("verdict", F.when(F.col("n") == 0, "waiting").when(F.col("n") < least, "info").when(F.col("rate") <= GATE, "go").otherwise("no_go"))


def tag_frequency(rows: DataFrame, tags: Column) -> DataFrame:
    """tag, n; order by n descending, then tag, where a list is shown."""
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def pass_rate(rows: DataFrame, **checks: Column) -> DataFrame:
    """Per check: passes, rows and the rate; one pass over the rows."""
    kinds = F.array(*(F.struct(F.lit(k).alias("check"), v.cast("int").alias("pass")) for k, v in checks.items()))
    return rows.select(F.explode(kinds).alias("k")).groupBy("k.check").agg(F.sum("k.pass").cast("long").alias("passed"), F.count("*").alias("n"), half_even(F.avg("k.pass"), 4).alias("rate"))


def lengths(rows: DataFrame, by: str, text: str) -> DataFrame:
    n = F.length(text)
    return rows.groupBy(by).agg(half_even(F.avg(n), 1).alias("avg_len"), F.median(n).alias("median_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"))


def weighted_score(anchor: Column, json: Column, seconds: Column, bounds: Column, coherence: Column) -> Column:
    """0 to 100: anchor x3, JSON x2, latency x2 (1 - t / 60, clamped), bounds, coherence."""
    speed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - seconds / 60))
    return half_even(100 * (3 * anchor + 2 * json + 2 * speed + bounds + coherence) / 9, 1)


def baseline_verdict(share: Column, n: Column, least: int, baseline: float = 28 / 52, keep: float = 0.7) -> Column:
    """Promotion from 70 % of the baseline on, withdrawal below, waiting while there are too few."""
    return F.when(n < least, "waiting").when(share >= keep * baseline, "promotion").otherwise("withdrawal")


def compliance(rows: DataFrame, by: str, value: str, limit: float) -> DataFrame:
    """Per group: rows, those within a limit, those beyond it, mean (six digits) and largest value."""
    v = F.col(value)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(v <= limit).alias("ok"), F.count_if(v > limit).alias("violators"), half_even(F.avg(v), 6).alias("avg"), F.max(v).alias("max"))
