"""Lookups: names contained in names, ordered sources, dictionaries, merged metadata, choice by preference, chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import ranges

#: So many names, and characters in them, go to every task as one search automaton; more are met in a join.
AUTOMATON_NAMES, AUTOMATON_CHARS = 200_000, 4_000_000
#: Beyond that names are found through their first so many characters (all of shorter names).
GRAM = 4


def _search(text: str, ranked: list[str], spark: SparkSession) -> Column:
    """The first of the ranked names that a text contains; one pass over the text."""
    sent = spark.sparkContext.broadcast({"names": ranked})

    @F.arrow_udf("string")
    def found(texts: pa.Array) -> pa.Array:
        automaton = sent.value.get("automaton")  # a worker process keeps it from task to task
        if automaton is None:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for k, name in enumerate(sent.value["names"]):
                automaton.add_word(name, k)
            automaton.make_automaton()
            sent.value["automaton"] = automaton
        names, out = sent.value["names"], []
        for t in texts:
            best = min((k for _, k in automaton.iter(t.as_py())), default=None) if t.is_valid else None
            out.append(None if best is None else names[best])
        return pa.array(out, pa.string())

    return found(F.col(text))


def _joined(rows: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """The same by an equi-join on the names' first characters. A place of a text carries as many characters as the longest name has, never the text; matches return to their row by the text's digest."""
    digest = F.sha2(F.encode(F.col(text), "UTF-8"), 256)
    longest = known.agg(F.max(F.length("__name"))).first()[0]
    places = rows.select(F.col(text).alias("__text")).filter(F.length("__text") > 0).select(F.sha2(F.encode("__text", "UTF-8"), 256).alias("__digest"), "__text").select(
        "__digest", F.explode(F.transform(F.sequence(F.lit(1), F.length("__text")), lambda i: F.substring(F.col("__text"), i, F.lit(longest)))).alias("__rest")
    ).distinct()
    grams = places.select("__digest", "__rest", F.explode(F.array_distinct(F.array(*(F.substring("__rest", 1, n) for n in range(1, GRAM + 1))))).alias("__gram"))
    named = known.withColumn("__gram", F.substring("__name", 1, GRAM))
    found = grams.join(named, "__gram").filter(F.startswith(F.col("__rest"), F.col("__name"))).groupBy("__digest").agg(F.min_by("__name", F.struct("__rank", "__name")).alias("match"))
    return rows.withColumn("__digest", digest).join(found, "__digest", "left").drop("__digest")


def first_contained(rows: DataFrame, text: str, names: DataFrame, name: str, rank: str) -> DataFrame:
    """rows with `match`: of the non-empty names contained in a text the one of smallest rank (of equals the smaller name), null if none.

    Any substring counts, across words too. The names are counted first: up to
    AUTOMATON_NAMES of together AUTOMATON_CHARS go to the tasks as one automaton, so
    the rows are scanned in place without a shuffle, in time linear in the text.
    More names meet the texts in a join.
    """
    known = names.filter((F.length(name) > 0) & F.col(rank).isNotNull()).groupBy(F.col(name).alias("__name")).agg(F.min(rank).alias("__rank"))
    n, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.length("__name")), F.lit(0))).first()
    rows = rows.drop("match")
    if n == 0:
        return rows.withColumn("match", F.lit(None).cast("string"))
    if n > AUTOMATON_NAMES or chars > AUTOMATON_CHARS:
        return _joined(rows, text, known)
    ranked = [r[0] for r in known.orderBy("__rank", "__name").select("__name").collect()]
    return rows.withColumn("match", _search(text, ranked, rows.sparkSession))


def exact_or_contained(rows: DataFrame, text: str, names: DataFrame, exact: str, name: str, rank: str) -> DataFrame:
    """rows with `match` and `how`: the smallest rank of names whose `exact` is the text, else of those contained in it."""
    first = names.groupBy(F.col(exact).alias(text)).agg(F.min_by(name, rank).alias("__exact"))
    both = first_contained(rows, text, names, name, rank).join(first, text, "left")
    how = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("match").isNotNull(), "contained").otherwise("none")
    return both.withColumn("how", how).withColumn("match", F.coalesce("__exact", "match")).drop("__exact")


def from_sources(rows: DataFrame, key: str, sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """rows with `value` and `source`: from the first source (table, its key, value) in order that knows the key; the smallest value of each key."""
    out = rows
    for name, (table, ref, value) in sources.items():
        out = out.join(table.filter(F.col(value).isNotNull()).groupBy(F.col(ref).alias(key)).agg(F.min(value).alias(f"__{name}")), key, "left")
    held = [F.col(f"__{name}") for name in sources]
    source = F.coalesce(*(F.when(c.isNotNull(), F.lit(name)) for name, c in zip(sources, held, strict=True)))
    return out.select(*rows.columns, F.coalesce(*held).alias("value"), source.alias("source"))


def dictionary(leaves: DataFrame, groups: DataFrame, strategies: DataFrame, notes: DataFrame) -> DataFrame:
    """leaf, root, sub, strategy, note: groups (root, sub, leaves array) name each leaf's place, a sub's strategy is required, a leaf's note is not."""
    place = groups.select("root", "sub", F.explode("leaves").alias("leaf"))
    return leaves.join(place, "leaf").join(strategies, "sub").join(notes, "leaf", "left").select("leaf", "root", "sub", "strategy", "note")


def memberships(rows: DataFrame, key: str, groups: DataFrame, name: str, members: str) -> DataFrame:
    """rows with the sorted names of the groups (name, members array) that their key is in; empty if none."""
    of = groups.select(name, F.explode(members).alias(key)).groupBy(key).agg(F.array_sort(F.collect_set(name)).alias(name))
    return rows.join(of, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def prefer_own(rows: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows whose null, empty-text or empty-array fields are taken from the other table, if it has one row of the key with a value."""
    more = other.select(key, *(F.col(f).alias(f"__other_{f}") for f in fields))
    kinds = dict(rows.dtypes)
    empty = lambda f, c: c.isNull() | (F.size(c) == 0 if kinds[f].startswith("array") else c.cast("string") == "")
    pick = lambda f: F.when(empty(f, F.col(f)) & ~empty(f, F.col(f"__other_{f}")), F.col(f"__other_{f}")).otherwise(F.col(f)).alias(f)
    return rows.join(more, key, "left").select(*(pick(c) if c in fields else F.col(c) for c in rows.columns))


def tag_union(entries: DataFrame, tags: str, notes: str) -> DataFrame:
    """The distinct trimmed tags of all entries, sorted; notes that are a JSON array of texts count as tags too."""
    old = F.when(F.ltrim(notes).startswith("["), F.from_json(notes, "array<string>"))
    none = F.array().cast("array<string>")
    every = entries.select(F.explode(F.concat(F.coalesce(tags, none), F.coalesce(old, none))).alias("tag")).select(F.trim("tag").alias("tag"))
    return every.filter("tag <> ''").distinct().orderBy("tag")


def first_wins(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """key and its first value in the given order: later ones do not replace it."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def preferred(rows: DataFrame, by: str, name: str, value: str, preference: list[str]) -> DataFrame:
    """Per group the value of the most preferred name that has one, then of the first by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(p) for p in preference)), F.col(name)), F.lit(0)), F.lit(len(preference) + 1))
    return rows.filter(F.col(value).isNotNull()).groupBy(by).agg(F.min_by(value, F.struct(place.alias("p"), name)).alias(value), F.min_by(name, F.struct(place.alias("p"), name)).alias(name))


def best_of_batch(rows: DataFrame, by: str, id: str, *rank: Column) -> DataFrame:
    """Per group the id of the smallest rank."""
    return rows.groupBy(by).agg(F.min_by(id, F.struct(*(c.alias(f"r{i}") for i, c in enumerate(rank)))).alias(id))


def seeded_sample(rows: DataFrame, id: str, n: int, seed: int) -> DataFrame:
    """n rows chosen by a digest of seed and id (all if there are fewer), sorted by id: the same on every run and machine."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string"))), id).limit(n).orderBy(id)


def first_row(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The first row of each group in the given order, whole; of the whole table without groups."""
    least = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")
    return (rows.groupBy(*by).agg(least) if by else rows.agg(least).filter("r is not null")).select("r.*")


def cut_then_match(rows: DataFrame, before: Column, exact: Column, order: list[Column], limit: int, offset: int = 0, cut_first: bool = True) -> DataFrame:
    """A page of rows that a cheap test lets through and the exact one keeps. With cut_first the page is cut after the cheap test, so it may come out short; else after the exact one."""
    if cut_first:
        return rows.filter(before).orderBy(*order).offset(offset).limit(limit).filter(exact)
    return rows.filter(before & exact).orderBy(*order).offset(offset).limit(limit)


def top(rows: DataFrame, score: Column, id: str, n: int = 10) -> DataFrame:
    """The n rows of highest score, then smallest id."""
    return rows.withColumn("score", score).orderBy(F.desc("score"), id).limit(n)


def suggestions(rows: DataFrame, name: str, query: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n names that contain the query (any case), sorted, and how many there are before that limit."""
    found = rows.filter(F.contains(F.lower(name), F.lit(query.lower())))
    return found.select(name).distinct().orderBy(name).limit(n), found.select(name).distinct().agg(F.count("*").alias("total"))


def chunks(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """rows with `chunk`: requests of at most so many rows of a group, in order (from 0)."""
    return ranges.row_numbers(rows, [by], [order], "chunk").withColumn("chunk", F.floor((F.col("chunk") - 1) / size).cast("long"))


def inserted_by_root(rows: DataFrame, root: str, id: str, n: int = 10) -> DataFrame:
    """Per root how many rows and its first n ids, each list bounded by n."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(root).orderBy(id)))
    sums = rows.groupBy(root).agg(F.count("*").alias("n"))
    return ranked.filter(F.col("__r") <= n).groupBy(root).agg(F.array_join(F.array_sort(F.collect_list(F.col(id).cast("string"))), ",").alias("first")).join(sums, root)


def suspicions(rows: DataFrame, id: str, names: dict[str, str], existing: DataFrame) -> DataFrame:
    """id and flags of generated terms: missing name, same names in two languages, word counts that differ by three or more, id or name taken.

    names: column per locale; existing has the same columns.
    """
    first, second = list(names.values())[:2]
    low = lambda c: F.lower(F.trim(c))
    out = rows.join(existing.select(F.col(id)).distinct().withColumn("__id", F.lit(True)), id, "left")
    for locale, c in names.items():
        taken = existing.select(low(c).alias(f"__{locale}")).filter(F.col(f"__{locale}") != "").distinct()
        out = out.withColumn(f"__k_{locale}", low(c)).join(taken, F.col(f"__k_{locale}") == F.col(f"__{locale}"), "left")
    words = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    flags = F.array_compact(
        F.array(
            F.when(blank(first) | blank(second), F.lit("missing")),
            F.when(~blank(first) & (low(first) == low(second)), F.lit("same_name")),
            F.when(~blank(first) & ~blank(second) & (F.abs(words(first) - words(second)) >= 3), F.lit("word_gap")),
            F.when(F.col("__id"), F.lit("duplicate_id")),
            *(F.when(F.col(f"__{locale}").isNotNull(), F.lit(f"duplicate_{locale}")) for locale in names),
        )
    )
    return out.select(id, flags.alias("flags"))


def validity(rows: DataFrame, by: str, parsed: Column, latency: Column, **criteria: Column) -> DataFrame:
    """Per group, over parsed rows only: how many, how many meet each criterion, and the mean latency."""
    return rows.filter(parsed).groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in criteria.items()), F.bround(F.avg(latency), 2).alias("mean_latency"))
