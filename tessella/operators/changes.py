"""Change sets against a current table: validation, differences, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = ("add", "update", "upsert", "remove")
STATUSES = ("ready", "update", "conflict", "error", "skip")


def normal_op(op: Column) -> Column:
    return F.when(op == "replace", "upsert").otherwise(op)


def validate(ops: DataFrame, current: DataFrame, id: str, parent: str | None = None, order: str = "idx") -> DataFrame:
    """ops with op (normalised), `exists`, `state` and `reason`.

    ops has `op`, an id, an order and, if asked for, a parent, which must exist
    already or be added earlier in the batch. The earliest addition of an id is
    a grouped minimum, so no window spans the batch.
    """
    normal = ops.withColumn("op", normal_op(F.col("op")))
    there = current.select(F.col(id)).distinct().withColumn("__there", F.lit(True))
    out = normal.join(there, id, "left").withColumn("exists", F.coalesce("__there", F.lit(False))).drop("__there")
    bad_parent = F.lit(False)
    if parent:
        added = normal.filter(F.col("op").isin("add", "upsert")).groupBy(F.col(id).alias(parent)).agg(F.min(order).alias("__added"))
        known = current.select(F.col(id).alias(parent)).distinct().withColumn("__known", F.lit(True))
        out = out.join(known, parent, "left").join(added, parent, "left")
        bad_parent = F.col(parent).isNotNull() & F.col("__known").isNull() & ~F.coalesce(F.col("__added") < F.col(order), F.lit(False))
    reason = (
        F.when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), "unknown_op")
        .when(F.col(id).isNull() | (F.trim(F.col(id).cast("string")) == ""), "missing_id")
        .when(bad_parent & (F.col("op") != "remove"), "missing_parent")
        .when((F.col("op") == "add") & F.col("exists"), "exists")
        .when((F.col("op") == "update") & ~F.col("exists"), "not_found")
        .when((F.col("op") == "remove") & ~F.col("exists"), "nothing_to_remove")
    )
    state = (
        F.when(reason.isin("unknown_op", "missing_id", "missing_parent", "not_found"), "error")
        .when(reason == "exists", "conflict")
        .when(reason == "nothing_to_remove", "skip")
        .when(F.col("op").isin("update", "upsert") & F.col("exists"), "update")
        .otherwise("ready")
    )
    return out.withColumn("reason", reason).withColumn("state", state).drop("__known", "__added")


def differences(incoming: DataFrame, current: DataFrame, key: str, fields: dict[str, Column] | list[str]) -> DataFrame:
    """key and changes array<struct<field, from, to>> of the provided (non-null) fields that differ; texts are trimmed."""
    names = list(fields)
    old = current.select(key, *(F.col(f).alias(f"__old_{f}") for f in names))
    joined = incoming.select(key, *names).join(old, key)
    text = lambda c: F.trim(c.cast("string"))
    changes = F.array_compact(F.array(*(F.when(F.col(f).isNotNull() & ~text(F.col(f)).eqNullSafe(text(F.col(f"__old_{f}"))), F.struct(F.lit(f).alias("field"), text(F.col(f"__old_{f}")).alias("from"), text(F.col(f)).alias("to"))) for f in names)))
    return joined.select(key, changes.alias("changes"))


def merge(current: DataFrame, incoming: DataFrame, keys: list[str], overwrite: list[str], keep: list[str] = ()) -> DataFrame:
    """Upsert: all rows of both with `action` INSERT, UPDATE or KEEP.

    Columns in overwrite take the incoming value where it is not null; columns in
    keep stay as they are on update and are taken on insert. Of several incoming
    rows of one key the largest (compared column by column) counts.
    """
    columns = [*overwrite, *keep]
    incoming = incoming.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("__row")).select(*keys, "__row.*")
    cur = current.select(*keys, *(F.col(c).alias(f"__c_{c}") for c in [*overwrite, *keep]), F.lit(True).alias("__c"))
    inc = incoming.select(*keys, *(F.col(c).alias(f"__i_{c}") for c in [*overwrite, *keep]), F.lit(True).alias("__i"))
    both = cur.join(inc, keys, "full_outer")
    action = F.when(F.col("__c").isNull(), "INSERT").when(F.col("__i").isNull(), "KEEP").otherwise("UPDATE")
    new = [F.coalesce(f"__i_{c}", f"__c_{c}").alias(c) for c in overwrite]
    held = [F.when(F.col("__c").isNull(), F.col(f"__i_{c}")).otherwise(F.col(f"__c_{c}")).alias(c) for c in keep]
    return both.select(*keys, *new, *held, action.alias("action"))


def summary(validated: DataFrame) -> DataFrame:
    """Counts per state, 0 for those that do not occur."""
    every = validated.sparkSession.range(1).select(F.explode(F.array(*(F.lit(s) for s in STATUSES))).alias("state"))
    n = validated.groupBy("state").agg(F.count("*").alias("n"))
    return every.join(n, "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def map_differences(current: DataFrame, proposed: DataFrame, key: str, value: str) -> DataFrame:
    """key, path, current, proposed of map-typed rows: what differs, path by path."""
    flat = lambda df, name: df.select(key, F.explode(value).alias("path", name))
    both = flat(current, "current").join(flat(proposed, "proposed"), [key, "path"], "full_outer")
    return both.filter(~F.col("current").eqNullSafe(F.col("proposed")))


def missing_rows(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of wanted whose keys do not exist yet (idempotent insert)."""
    return wanted.join(existing.select(*keys).distinct(), keys, "left_anti")


def changed_content(rows: DataFrame, key: str, content: str, manifest: DataFrame) -> DataFrame:
    """rows with sha256 and `write`: whether the content differs from the manifest (key, sha256)."""
    hashed = rows.withColumn("sha256", F.sha2(F.encode(content, "UTF-8"), 256))
    old = manifest.select(key, F.col("sha256").alias("__old"))
    return hashed.join(old, key, "left").withColumn("write", ~F.col("sha256").eqNullSafe(F.col("__old"))).drop("__old")


def earlier_duplicate(rows: DataFrame, by: str, order: str) -> DataFrame:
    """rows with `first_id`: the smallest order of equal values."""
    return rows.withColumn("first_id", F.min(order).over(Window.partitionBy(by)))


def content_duplicates(rows: DataFrame, id: str, content: str) -> DataFrame:
    """md5, n, first_id of contents that occur more than once; only digests are shuffled."""
    return rows.groupBy(F.md5(content).alias("md5")).agg(F.count("*").alias("n"), F.min(id).alias("first_id")).filter("n > 1")
