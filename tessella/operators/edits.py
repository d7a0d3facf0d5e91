"""Edits of a table as new tables: applying reviewed changes, backfills, replacements, guarded and cascading deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.values import is_blank
from tessella.operators import tables, trees

#: States that the arrival of an output moves on, and the state they move to.
BEFORE_OUTPUT, WITH_OUTPUT = ("scheduled", "generating", "draft", "prompt_ready"), "generated"
#: Old states and what became of them.
OLD_STATES = {"raw": "generated", "reviewed": "generated", "approved": "approved", "rejected": "rejected"}


def apply_ops(validated: DataFrame, current: DataFrame, key: str, fields: list[str], order: str = "idx", with_updates: bool = False) -> DataFrame:
    """current after a validated change set (key, op, state, order, fields); of several effective ops on a key the last decides.

    Additions and upserts that are ready or update take the given fields and keep
    the others from the current row; removals go. Plain `update` ops are validated
    but have no effect unless with_updates is set, as their producers expect.
    """
    writes = F.col("op").isin("add", "upsert", *(["update"] if with_updates else [])) & F.col("state").isin("ready", "update")
    removes = (F.col("op") == "remove") & (F.col("state") == "ready")
    last = tables.best(validated.filter(writes | removes), [key], F.desc(order))
    new = last.select(key, F.lit(True).alias("__new"), (F.col("op") == "remove").alias("__gone"), *(F.col(f).alias(f"__new_{f}") for f in fields))
    old = current.select(key, *fields)
    both = old.join(new, key, "full_outer").filter(~F.coalesce("__gone", F.lit(False)))
    return both.select(key, *(F.coalesce(f"__new_{f}", f).alias(f) for f in fields))


def apply_fields(current: DataFrame, proposed: DataFrame, key: str, fields: list[str], chosen: str) -> DataFrame:
    """current with the proposed values of the fields that a proposal's `chosen` array names (none named: all it proposes)."""
    new = proposed.select(key, F.coalesce(chosen, F.array().cast("array<string>")).alias("__chosen"), *(F.col(f).alias(f"__new_{f}") for f in fields))
    joined = current.join(new, key, "left")
    takes = lambda f: F.col(f"__new_{f}").isNotNull() & ((F.size("__chosen") == 0) | F.array_contains("__chosen", f))
    changed = F.array_compact(F.array(*(F.when(takes(f), F.lit(f)) for f in fields)))
    return joined.select(*(F.when(takes(c), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in current.columns), changed.alias("changed"))


def bulk_outcome(asked: DataFrame, rows: DataFrame, id: str, status: str, needed: str, action: Column) -> DataFrame:
    """Each asked id (once) with `outcome` applied, rejected or error, and the error's `message`; one bad id does not stop the others."""
    found = asked.select(id).distinct().join(rows.select(id, F.col(status).alias("__status")), id, "left")
    message = F.when(F.col("__status").isNull(), "not_found").when(F.col("__status") != needed, F.concat(F.lit("status is "), F.col("__status")))
    return found.select(id, F.when(message.isNotNull(), "error").when(action == "reject", "rejected").otherwise("applied").alias("outcome"), message.alias("message"))


def concept_counts(proposed: DataFrame, by: str, id: str, existing: DataFrame) -> DataFrame:
    """Per group: proposed ids (blank ones left out) that are new and that exist already."""
    known = existing.select(F.col(id).alias("__id")).distinct().withColumn("__known", F.lit(True))
    given = proposed.filter(~is_blank(F.col(id).cast("string")))
    flagged = given.join(known, given[id] == known["__id"], "left")
    return flagged.groupBy(by).agg(F.count_if(F.col("__known").isNull()).alias("new"), F.count_if(F.col("__known")).alias("duplicate"))


def typed_differences(incoming: DataFrame, current: DataFrame, key: str, texts: list[str] = (), numbers: list[str] = (), lists: list[str] = (), parents: list[str] = ()) -> DataFrame:
    """key, changes array<struct<field, from, to>> of the provided fields, and state update or skip.

    Texts are compared trimmed, numbers as integers, lists in sorted order, and a
    blank parent is no parent.
    """
    kinds = {
        **{f: lambda c: F.trim(c.cast("string")) for f in texts},
        **{f: lambda c: c.cast("int").cast("string") for f in numbers},
        **{f: lambda c: F.array_join(F.array_sort(c), ",") for f in lists},
        **{f: lambda c: F.nullif(F.trim(c.cast("string")), F.lit("")) for f in parents},
    }
    old = current.select(key, *(F.col(f).alias(f"__old_{f}") for f in kinds))
    tests = []
    for f, as_text in kinds.items():
        before, after = as_text(F.col(f"__old_{f}")), as_text(F.col(f))
        tests.append(F.when(F.col(f).isNotNull() & ~before.eqNullSafe(after), F.struct(F.lit(f).alias("field"), before.alias("from"), after.alias("to"))))
    out = incoming.select(key, *kinds).join(old, key).select(key, F.array_compact(F.array(*tests)).alias("changes"))
    return out.withColumn("state", F.when(F.size("changes") > 0, "update").otherwise("skip"))


def with_output(status: Column) -> Column:
    """The state once an output has come; states that are beyond it stay."""
    return F.when(status.isin(*BEFORE_OUTPUT), WITH_OUTPUT).otherwise(status)


def fill_from_first(rows: DataFrame, column: str, applies: Column, sources: list[tuple[DataFrame, str, str, str]], key: str) -> DataFrame:
    """rows with missing values of a column taken from the first source that has any: (table, its key, value, order); the first of each key by order."""
    out = rows
    names = []
    for n, (table, ref, value, order) in enumerate(sources):
        names.append(f"__from_{n}")
        out = out.join(table.groupBy(F.col(ref).alias(key)).agg(F.min_by(value, F.struct(order, value)).alias(names[-1])), key, "left")
    filled = F.coalesce(column, F.when(applies, F.coalesce(*names)))
    return out.select(*(filled.alias(c) if c == column else F.col(c) for c in rows.columns))


def fill_columns(rows: DataFrame, id: str, title: str, prompt: str, used_prompt: str, status: str) -> DataFrame:
    """Backfill of a former layout: blank titles from the used prompt, else the id; blank prompts likewise; old states renamed, none becomes draft."""
    used = F.nullif(F.trim(used_prompt), F.lit(""))
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    state = reduce(lambda acc, kv: acc.when(F.col(status) == kv[0], kv[1]), list(OLD_STATES.items())[1:], F.when(F.col(status) == "raw", OLD_STATES["raw"])).otherwise(F.coalesce(status, F.lit("draft")))
    new = {title: F.when(blank(title), F.coalesce(used, F.col(id).cast("string"))).otherwise(F.col(title)), prompt: F.when(blank(prompt), F.col(used_prompt)).otherwise(F.col(prompt)), status: state}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in rows.columns))


def replace_sets(rows: DataFrame, key: str, new: DataFrame, replaced: DataFrame) -> DataFrame:
    """rows without those of the replaced keys, and the new rows of these keys, each once; a key without new rows ends up empty. The keys, each once, are hashed and the rows stream past them unsorted."""
    keys = replaced.select(key).distinct().hint("shuffle_hash")
    return rows.join(keys, key, "left_anti").unionByName(new.join(keys, key, "left_semi").select(*rows.columns).distinct())


def cascade_delete(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """nodes without the start ids and all below them."""
    return nodes.join(trees.walk(nodes, start).select("id").distinct(), "id", "left_anti")


def guarded_delete(nodes: DataFrame, wanted: DataFrame, references: dict[str, tuple[DataFrame, str]], cascade: bool = False) -> DataFrame:
    """Each wanted id with `outcome`: deleted, referenced, has_children (unless cascade) or not_found, and its reference counts."""
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    there = wanted.select("id").distinct().join(nodes.select("id", F.lit(True).alias("__there")).distinct(), "id", "left").join(children, "id", "left")
    counted = tables.counts_by_key(wanted.select("id").distinct(), "id", **references)
    total = reduce(lambda a, b: a + b, (F.col(n) for n in references), F.lit(0))
    outcome = F.when(F.col("__there").isNull(), "not_found").when(total > 0, "referenced").when(F.coalesce("children", F.lit(0)) > F.lit(0 if not cascade else 2**62), "has_children").otherwise("deleted")
    return there.join(counted, "id").select("id", *references, F.coalesce("children", F.lit(0)).cast("long").alias("children"), outcome.alias("outcome"))


def eligible(asked: DataFrame, items: DataFrame, id: str, status: str, prompt: str, jobs: DataFrame, ready: str, active: tuple[str, ...]) -> DataFrame:
    """Each asked id (once) with the reason why no job may start for it: unknown, status_<state>, empty_prompt, active_job; null if one may.

    jobs (id, status): an active one blocks its item.
    """
    busy = jobs.filter(F.col("status").isin(*active)).select(id).distinct().withColumn("__busy", F.lit(True))
    known = items.select(id, F.lit(True).alias("__there"), F.coalesce(F.trim(F.col(status)), F.lit("")).alias("__status"), is_blank(F.col(prompt)).alias("__blank"))
    found = asked.select(id).distinct().join(known, id, "left").join(busy, id, "left")
    reason = (
        F.when(F.col("__there").isNull(), "unknown")
        .when(F.col("__status") != ready, F.concat(F.lit("status_"), F.when(F.col("__status") == "", "blank").otherwise(F.col("__status"))))
        .when(F.col("__blank"), "empty_prompt")
        .when(F.coalesce("__busy", F.lit(False)), "active_job")
    )
    return found.select(id, reason.alias("reason"))


def planned_variants(checked: DataFrame, id: str, variants: list[str], existing: DataFrame) -> DataFrame:
    """Pairs (id, variant) of the checked ids (id, reason) with `outcome` create, skipped (exists already) or failed, and the reason.

    The variants are a short list in the code, so each id gives that many rows.
    """
    pairs = checked.select(id, "reason", F.explode(F.array(*(F.lit(v) for v in variants))).alias("variant"))
    held = existing.select(id, "variant").distinct().withColumn("__held", F.lit(True))
    outcome = F.when(F.col("reason").isNotNull(), "failed").when(F.col("__held"), "skipped").otherwise("create")
    return pairs.join(held, [id, "variant"], "left").select(id, "variant", outcome.alias("outcome"), F.coalesce("reason", F.when(F.col("__held"), "exists")).alias("reason"))


def cut_over(rows: DataFrame, status: str, before: str = "approved", after: str = "published") -> tuple[DataFrame, DataFrame]:
    """rows with one state renamed, and the counts by outcome: changed, already, other."""
    outcome = F.when(F.col(status) == before, "changed").when(F.col(status) == after, "already").otherwise("other")
    kinds = rows.sparkSession.createDataFrame([("changed",), ("already",), ("other",)], "outcome string")
    counted = rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
    moved = rows.withColumn(status, F.when(F.col(status) == before, after).otherwise(F.col(status)))
    return moved, kinds.join(counted, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
