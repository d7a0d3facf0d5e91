"""Filters, pages, joins and row choice over any tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.values import all_of
from tessella.session import use_shared_checkpoints


def where(rows: DataFrame, *, equal: dict | None = None, among: dict | None = None, at_least: dict | None = None, at_most: dict | None = None, blank: dict | None = None, more: Iterable[Column] = ()) -> DataFrame:
    """Conjunction of the filters that are given; a None value means no filter."""
    tests = [F.col(k) == v for k, v in (equal or {}).items() if v is not None]
    tests += [F.col(k).isin(*v) for k, v in (among or {}).items() if v]
    tests += [F.col(k) >= v for k, v in (at_least or {}).items() if v is not None]
    tests += [F.col(k) <= v for k, v in (at_most or {}).items() if v is not None]
    tests += [(F.col(k).isNull() | (F.col(k) == "")) == v for k, v in (blank or {}).items() if v is not None]
    return rows.filter(all_of([*tests, *more]))


def ordered(rows: DataFrame, sort: str, direction: str, allowed: tuple[str, ...], tie: str) -> DataFrame:
    """Sort by a whitelisted column (the first allowed one otherwise); anything but `desc` ascends; ties by a unique key."""
    column = F.col(sort if sort in allowed else allowed[0])
    return rows.orderBy(column.desc_nulls_last() if direction.lower() == "desc" else column.asc_nulls_last(), F.col(tie))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Rows of a page (from 1) of an ordered DataFrame."""
    return rows.offset(max(number - 1, 0) * size).limit(size)


def counts_by_key(keys: DataFrame, key: str, **tables: tuple[DataFrame, str]) -> DataFrame:
    """Per key how many rows of each table refer to it; each side is summed before its join."""
    out = keys.select(key)
    for name, (rows, ref) in tables.items():
        n = rows.groupBy(F.col(ref).alias(key)).agg(F.count("*").alias(name))
        out = out.join(n, key, "left")
    return out.select(key, *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in tables))


def longest_prefix(rows: DataFrame, name: str, known: DataFrame, key: str, separator: str = "_") -> DataFrame:
    """rows with `match`: the longest known key that is name or a token prefix of it, null if none.

    Every prefix is a join key, so it stays an equi-join; the names' tokens bound
    the rows it makes.
    """
    prefixes = F.transform(F.sequence(F.size("tokens"), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice("tokens", F.lit(1), n), separator))
    keys = known.select(F.col(key).alias("prefix")).distinct()
    names = rows.select(name).distinct().withColumn("tokens", F.split(name, separator)).withColumn("prefix", F.explode(prefixes))
    found = names.join(keys, "prefix").groupBy(name).agg(F.max_by("prefix", F.length("prefix")).alias("match"))
    return rows.drop("match").join(found, name, "left")


def best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in an order; the order should end with a unique key."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def sample_per_class(rows: DataFrame, by: str, id: str, n: int, seed: int) -> DataFrame:
    """n rows a class, chosen by a hash of id and seed: the same on every run."""
    return best_n(rows, [by], n, F.xxhash64(F.col(id), F.lit(seed)), F.col(id))


def best_n(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= n).drop("__rank")


def unique_slugs(rows: DataFrame, id: str, r2: str, posts: str) -> DataFrame:
    """Greedy choice in id order: rows with `outcome` kept, r2_taken or slug_taken.

    posts is array<struct<locale, slug>>. A row whose r2 slug an earlier row has
    reserved goes first; one whose (locale, slug) an earlier kept row holds goes
    second but keeps its r2 reservation. The second choice depends on earlier
    outcomes, so rows that share a slug, directly or through others, are settled
    together: groups of colliding rows are components of the slug graph, found
    by the smallest id; each is settled in order on its own.
    """
    use_shared_checkpoints(rows.sparkSession)
    first = rows.withColumn("__r2", F.row_number().over(Window.partitionBy(r2).orderBy(id)))
    taken = first.filter("__r2 > 1").drop("__r2").withColumn("outcome", F.lit("r2_taken"))
    alive = first.filter("__r2 = 1").drop("__r2")
    slugs = alive.select(F.col(id).alias("__id"), F.explode(posts).alias("p")).select("__id", F.concat_ws("/", "p.locale", "p.slug").alias("k"))
    clash = slugs.groupBy("k").agg(F.min("__id").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    edges = slugs.join(clash, "k").select("__id", "lead").distinct()
    label = edges.groupBy("__id").agg(F.min("lead").alias("label"))
    while True:  # label of a row: smallest label among rows that share a slug with it
        near = slugs.join(label, "__id").groupBy("k").agg(F.min("label").alias("low"))
        new = slugs.join(near, "k").groupBy("__id").agg(F.min("low").alias("label")).checkpoint()
        moved = new.join(label.withColumnRenamed("label", "old"), "__id").filter("label < old")
        done = moved.isEmpty()
        label = new
        if done:
            break

    def settle(pdf):
        held: set[str] = set()
        out = []
        for _, keys in pdf.sort_values("__id")[["__id", "ks"]].itertuples(index=False):
            free = not held.intersection(keys)
            held.update(keys if free else ())
            out.append("kept" if free else "slug_taken")
        return pdf.sort_values("__id").assign(outcome=out)[["__id", "outcome"]]

    groups = slugs.groupBy("__id").agg(F.collect_set("k").alias("ks")).join(label, "__id")
    settled = groups.groupBy("label").applyInPandas(settle, f"__id {dict(rows.dtypes)[id]}, outcome string")
    kept = alive.join(settled, alive[id] == settled["__id"], "left").drop("__id").withColumn("outcome", F.coalesce("outcome", F.lit("kept")))
    return kept.unionByName(taken)
