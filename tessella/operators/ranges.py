"""Order within groups of any size: ranges of a group are sorted apart, and what lies before a range is known from its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import use_shared_checkpoints


def in_ranges(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with `__range`: the range of (by, order) that they are in. Ranges are about equally large, in ascending order, and a group may have many; rows of equal values are in one. The split is kept, as it would not be the same when drawn again."""
    use_shared_checkpoints(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *by, *order).withColumn("__range", F.spark_partition_id()).checkpoint()


def before(ranged: DataFrame, by: list[str], amount: Column) -> DataFrame:
    """by, __range, __before, __inside: how much of a group lies in its earlier ranges, and in each; as many rows as ranges and groups."""
    inside = ranged.groupBy(*by, "__range").agg(F.sum(amount).alias("__inside"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return inside.withColumn("__before", F.coalesce(F.sum("__inside").over(earlier), F.lit(0)))


def row_numbers(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number (from 1) in their group, counted over its ranges."""
    ranged = in_ranges(rows, by, order)
    first = before(ranged, by, F.lit(1)).drop("__inside")
    numbered = ranged.withColumn(name, F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order)))
    return numbered.join(first, [*by, "__range"]).withColumn(name, F.col(name) + F.col("__before")).select(*rows.columns, name)
