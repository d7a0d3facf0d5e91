"""Pixels and vectors: statistics, palettes, regions. Pixels are rows (image, y, x, region, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.colors import distance
from tessella.functions.values import half_even
from tessella.session import use_shared_checkpoints


#: Most entries of a palette; each row or entry is compared with all of them.
PALETTE = 4096


def _checked(palette: DataFrame) -> DataFrame:
    """The palette, if it is one: larger tables need another join than a scan of all entries."""
    n = palette.count()
    if n > PALETTE:
        raise ValueError(f"a palette has at most {PALETTE} entries, this one has {n}")
    return palette


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v)


def std(v: Column) -> Column:
    """Population standard deviation of an array."""
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x) / F.size(v)
    return F.sqrt(F.greatest(squares - mean(v) * mean(v), F.lit(0.0)))


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """label, center: mean vector of each label, summed per component."""
    parts = rows.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("p", "x")).groupBy(label, "p").agg(F.avg("x").alias("x"))
    return parts.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("c")).select(label, F.col("c.x").alias("center"))


def nearest(rows: DataFrame, id: str, vector: str, palette: DataFrame, label: str, center: str) -> DataFrame:
    """id, nearest, dist: the closest palette entry, the smaller label of equals.

    The palette is a dimension of a few entries (at most PALETTE, counted first);
    it is gathered into one array that each row scans, so no pairs of rows are made.
    """
    entries = _checked(palette).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col(center).alias("center")))).alias("palette"))
    joined = rows.join(F.broadcast(entries), F.lit(True), "left")
    scored = F.transform("palette", lambda p: F.named_struct(F.lit("dist"), F.round(distance(F.col(vector).cast("array<double>"), p["center"]), 6), F.lit("label"), p["label"]))
    return joined.select(id, F.array_min(scored).alias("best")).select(id, F.col("best.label").alias("nearest"), F.col("best.dist").alias("dist"))


def merge_close(palette: DataFrame, label: str, center: str, limit: float) -> DataFrame:
    """id, canonical: entries nearer than limit, directly or through others, share their smallest label.

    A palette has a few entries (at most PALETTE, counted first), so its pairs are
    few; labels spread until none changes.
    """
    use_shared_checkpoints(palette.sparkSession)
    palette = _checked(palette.checkpoint())
    a = palette.select(F.col(label).alias("a"), F.col(center).alias("ca"))
    b = palette.select(F.col(label).alias("b"), F.col(center).alias("cb"))
    edges = a.join(F.broadcast(b), (F.col("a") != F.col("b")) & (distance(F.col("ca"), F.col("cb")) < limit)).select("a", "b").checkpoint()
    state = palette.select(F.col(label).alias("id"), F.col(label).alias("canonical"))
    while True:
        low = edges.join(state.select(F.col("id").alias("b"), "canonical"), "b").groupBy(F.col("a").alias("id")).agg(F.min("canonical").alias("low"))
        new = state.join(low, "id", "left").select("id", F.least("canonical", F.coalesce("low", "canonical")).alias("canonical"), F.col("canonical").alias("old")).checkpoint()
        if new.filter("canonical < old").isEmpty():
            return new.select("id", "canonical")
        state = new.select("id", "canonical")


def region_stats(pixels: DataFrame, value: str) -> DataFrame:
    return pixels.groupBy("image", "region").agg(F.count("*").alias("area"), half_even(F.avg(value), 6).alias("mean"))


def neighbours(pixels: DataFrame) -> DataFrame:
    """image, region, other: each side of each pixel border between two regions.

    A pixel is sent to its right and lower neighbour's place and joined there, so
    every border is one equi-join row.
    """
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0))))
    sent = pixels.select("image", F.col("region").alias("one"), "y", "x", F.explode(steps).alias("s")).select("image", "one", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    met = sent.join(pixels.select("image", "y", "x", F.col("region").alias("two")), ["image", "y", "x"]).filter("one <> two").select("image", "one", "two")
    return met.select("image", F.explode(F.array(F.struct(F.col("one").alias("region"), F.col("two").alias("other")), F.struct(F.col("two").alias("region"), F.col("one").alias("other")))).alias("n")).select("image", "n.*")


def adjacency(pixels: DataFrame) -> DataFrame:
    return neighbours(pixels).filter("region < other").select("image", F.col("region").alias("a"), F.col("other").alias("b")).distinct()


def small_into_majority(pixels: DataFrame, least: int) -> DataFrame:
    """image, region, into_region: for regions under `least` pixels the region they share most border with."""
    small = pixels.groupBy("image", "region").agg(F.count("*").alias("area")).filter(F.col("area") < least)
    sides = neighbours(pixels).groupBy("image", "region", "other").agg(F.count("*").alias("n"))
    return small.join(sides, ["image", "region"]).groupBy("image", "region").agg(F.max_by("other", F.struct("n", -F.col("other"))).alias("into_region"))


def largest(shapes: DataFrame, area: str, id: str, n: int) -> DataFrame:
    """The n largest shapes with their place (from 1), of equals the smaller id first."""
    top = shapes.orderBy(F.desc(area), id).limit(n)
    return top.select("*", F.row_number().over(Window.orderBy(F.desc(area), id)).cast("long").alias("place"))  # n rows
