"""Trees as adjacency rows (id, parent): levels, paths, subtrees, leaves, checks.

Walks go level by level from the roots until a level is empty; each level is one
join with a checkpoint, so the number of joins is the depth of the tree, not the
number of nodes, and no level is computed twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import use_shared_checkpoints


def walk(nodes: DataFrame, start: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """id, parent, level (from 1), root, path array<id>, from the roots or from the given start ids; down to `depth` levels or to the end.

    A node that would be below itself is not entered again.
    """
    use_shared_checkpoints(nodes.sparkSession)
    n = nodes.select("id", "parent")
    first = n.filter("parent is null") if start is None else n.join(start.select("id"), "id", "left_semi")
    level = first.select("id", "parent", F.lit(1).alias("level"), F.col("id").alias("root"), F.array("id").alias("path")).checkpoint()
    levels = [level]
    while depth is None or len(levels) < depth:
        above = level.select(F.col("id").alias("up"), "level", "root", "path")
        below = n.join(above, n["parent"] == above["up"]).filter(~F.array_contains("path", F.col("id")))
        level = below.select("id", "parent", (F.col("level") + 1).alias("level"), "root", F.array_append("path", F.col("id")).alias("path")).checkpoint()
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def pre_order(nodes: DataFrame, start: DataFrame, weight: Column) -> DataFrame:
    """id, level, place (from 1) of the start ids and all below them, each before its children, siblings by weight (null: 0), then id.

    A node's place is the sum, over itself and the nodes above it, of 1 and of the
    sizes of the earlier siblings' subtrees; siblings are the largest group.
    """
    key = nodes.select("id", F.coalesce(weight, F.lit(0)).cast("double").alias("w"))
    found = walk(nodes, start).join(key, "id")
    steps = found.select("root", "id", F.explode("path").alias("step"))
    sizes = steps.groupBy("root", "step").agg(F.count("*").alias("size")).withColumnRenamed("step", "id")
    earlier = Window.partitionBy("root", "parent").orderBy("w", "id").rowsBetween(Window.unboundedPreceding, -1)
    sized = found.join(sizes, ["root", "id"])
    # a start node stands alone, whatever its parent has besides
    ahead = sized.filter("level > 1").withColumn("ahead", 1 + F.coalesce(F.sum("size").over(earlier), F.lit(0))).select("root", F.col("id").alias("step"), "ahead")
    ahead = ahead.unionByName(sized.filter("level = 1").select("root", F.col("id").alias("step"), F.lit(1).cast("long").alias("ahead")))
    places = steps.join(ahead, ["root", "step"]).groupBy("root", "id").agg(F.sum("ahead").cast("int").alias("place"))
    return found.join(places, ["root", "id"]).select("id", "root", "level", "place")


def with_children(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """The named nodes and their direct children."""
    return nodes.filter(F.col("id").isin(*ids) | F.col("parent").isin(*ids))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    parents = nodes.filter("parent is not null").select(F.col("parent").alias("id")).distinct()
    return nodes.join(parents, "id", "left_anti")


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is named but missing."""
    ids = nodes.select(F.col("id").alias("parent")).distinct()
    return nodes.filter("parent is not null").join(ids, "parent", "left_anti")


def nested(nodes: DataFrame, weight: Column) -> DataFrame:
    """Three-level trees as JSON text per root, siblings by weight (null: 0), then id."""
    n = nodes.filter("trim(id) <> ''").select("id", "parent", F.coalesce(weight, F.lit(0)).alias("w"))

    def gather(children: DataFrame, inner: str | None) -> DataFrame:
        fields = ["w", "id"] + ([inner] if inner else [])
        return children.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("children"))

    third = gather(n, None).withColumnRenamed("children", "c3").withColumnRenamed("parent", "id")
    second = gather(n.join(third, "id", "left"), "c3").withColumnRenamed("children", "c2").withColumnRenamed("parent", "id")
    return n.filter("parent is null").join(second, "id", "left").select("id", F.to_json(F.struct("id", F.col("c2").alias("children"))).alias("tree"))


def coverage(nodes: DataFrame, group: str, labelled: Column) -> DataFrame:
    """Per group: nodes, labelled nodes, leaves, labelled leaves and both shares in percent (one digit)."""
    parents = nodes.filter("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("inner", F.lit(True))
    flagged = nodes.withColumn("labelled", labelled).join(parents, "id", "left").withColumn("leaf", F.col("inner").isNull())
    share = lambda a, b: F.bround(F.when(b > 0, 100.0 * a / b).otherwise(0.0), 1)
    sums = flagged.groupBy(group).agg(F.count("*").alias("total"), F.count_if("labelled").alias("with_label"), F.count_if("leaf").alias("leaves"), F.count_if(F.col("leaf") & F.col("labelled")).alias("leaves_with_label"))
    return sums.select("*", share(F.col("with_label"), F.col("total")).alias("share"), share(F.col("leaves_with_label"), F.col("leaves")).alias("leaf_share"))


def integrity(nodes: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Checks of a tree: (name, expected, actual, ok) for level counts, orphans, duplicate and blank ids."""
    levels = walk(nodes, depth=3).groupBy("level").count()
    actual = {
        **{f"level_{k}": levels.filter(F.col("level") == k).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("actual")) for k in (1, 2, 3)},
        "orphans": orphans(nodes).agg(F.count("*").alias("actual")),
        "duplicates": nodes.groupBy("id").count().filter("count > 1").agg(F.count("*").alias("actual")),
        "blank": nodes.filter("id is null or trim(id) = ''").agg(F.count("*").alias("actual")),
    }
    parts = [df.select(F.lit(name).alias("name"), F.lit(expected.get(name, 0)).cast("long").alias("expected"), "actual") for name, df in actual.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("ok", F.col("expected") == F.col("actual"))
