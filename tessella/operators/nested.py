"""Nested objects of any depth, as VARIANT: paths and values, deep differences, nodes of nested trees.

Each step of `leaves` and `nodes` takes all objects and arrays of one depth apart
at once; there are as many steps as the deepest value has levels, whatever the
number of rows. `deep_diff` takes a pair of documents apart in place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from itertools import zip_longest
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.session import use_shared_checkpoints

FIELDS, ITEMS = "map<string,variant>", "array<variant>"


def _is(value: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit(kind))


def texts_only(value: Column) -> Column:
    """Whether a variant is an object whose values are all strings (a map of translations)."""
    return _is(value, "OBJECT") & F.forall(F.map_values(F.try_variant_get(value, "$", FIELDS)), lambda v: F.schema_of_variant(v) == "STRING")


def leaves(rows: DataFrame, key: str, doc: str, flat: bool = False) -> DataFrame:
    """key, path, value (variant): everything in a document that holds nothing else, empty objects and arrays too. Paths are a.b[0].c; a scalar document has the path ''.

    flat: arrays, and objects of nothing but strings below the top, count as values.
    """
    use_shared_checkpoints(rows.sparkSession)
    level = rows.filter(F.col(doc).isNotNull()).select(key, F.lit("").alias("path"), F.col(doc).alias("value"), F.lit(True).alias("top"))
    found = []
    while True:
        open_ = (_is(F.col("value"), "OBJECT") & ~(texts_only(F.col("value")) & ~F.col("top"))) if flat else (_is(F.col("value"), "OBJECT") | _is(F.col("value"), "ARRAY"))
        size = F.coalesce(F.size(F.map_keys(F.try_variant_get("value", "$", FIELDS))), F.size(F.try_variant_get("value", "$", ITEMS)), F.lit(0))
        level = level.withColumn("open", open_ & (size > 0)).checkpoint()
        found.append(level.filter("not open").select(key, "path", "value"))
        held = level.filter("open")
        if held.isEmpty():
            return reduce(DataFrame.unionByName, found)
        objects = held.filter(_is(F.col("value"), "OBJECT")).select(key, "path", F.explode(F.try_variant_get("value", "$", FIELDS)).alias("__k", "__v"))
        fields = objects.select(key, F.when(F.col("path") == "", F.col("__k")).otherwise(F.concat("path", F.lit("."), "__k")).alias("path"), F.col("__v").alias("value"))
        arrays = held.filter(_is(F.col("value"), "ARRAY")).select(key, "path", F.posexplode(F.try_variant_get("value", "$", ITEMS)).alias("__k", "__v"))
        items = arrays.select(key, F.concat("path", F.lit("["), F.col("__k").cast("string"), F.lit("]")).alias("path"), F.col("__v").alias("value"))
        level = fields.unionByName(items).withColumn("top", F.lit(False))


#: In JSON text: an empty key, or one with a dot or bracket; its path may be that of another value.
_AMBIGUOUS = re.compile(r'(?:""|[.\[](?:[^"\\]|\\.)*"):')
#: What a document lacks at a path (a singleton, also in tasks).
_NOTHING = ...


def deep_diff(current: DataFrame, proposed: DataFrame, key: str, doc: str, flat: bool = False) -> DataFrame:
    """key, path, kind (changed, added, removed), current, proposed (JSON text): what differs between two documents of a key, value by value. flat as in `leaves`.

    The documents of a key meet first and are taken apart together, where they
    are; what is equal in both is passed over. So only differences are stored,
    once, however deep they lie. Keys with several documents on a side, and
    documents with ambiguous paths, go by their leaves.
    """
    use_shared_checkpoints(current.sparkSession)
    once = lambda docs, name: docs.select(key, F.to_json(doc).alias(name), F.count("*").over(Window.partitionBy(key)).alias(f"{name}n"))
    texts = once(current, "__a").join(once(proposed, "__b"), key, "full_outer")
    odd = F.col(key).isNotNull() & (F.greatest("__an", "__bn") > 1)
    pairs = texts.select(key, "__a", "__b", odd.alias("__odd")).filter("__odd or not __a <=> __b")

    def apart(batches):
        parsed = json.JSONDecoder(parse_int=_number, parse_float=_number).decode
        for batch in batches:
            at, out = [], []
            for i, (a, b, several) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                if several or (a is not None and b is not None and (_AMBIGUOUS.search(a) or _AMBIGUOUS.search(b))):
                    rows = [(None, None, None, True)]
                else:
                    rows = [(*r, False) for r in _differences(*(_NOTHING if t is None else parsed(t) for t in (a, b)), flat)]
                out += rows
                at += [i] * len(rows)
            path, one, two, odd = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in (path, one, two)), pa.array(odd, pa.bool_())], [key, "path", "current", "proposed", "__odd"])

    schema = StructType([pairs.schema[key]]).add("path", "string").add("current", "string").add("proposed", "string").add("__odd", "boolean")
    stored = pairs.mapInArrow(apart, schema).checkpoint()
    found = _kinds(stored.filter("not __odd"), key)
    if stored.filter("__odd").isEmpty():
        return found
    keys = stored.filter("__odd").select(F.col(key).alias("__key")).distinct()
    of = lambda docs, name: leaves(docs.join(keys, F.col(key) == F.col("__key"), "left_semi"), key, doc, flat).select(key, "path", F.to_json("value").alias(name))
    both = of(current, "current").join(of(proposed, "proposed"), [key, "path"], "full_outer")
    return found.unionByName(_kinds(both.filter("not current <=> proposed"), key))


def _kinds(both: DataFrame, key: str) -> DataFrame:
    kind = F.when(F.col("current").isNull(), "added").when(F.col("proposed").isNull(), "removed").otherwise("changed")
    return both.select(key, "path", kind.alias("kind"), "current", "proposed")


def _differences(a: object, b: object, flat: bool) -> Iterator[tuple[str, str | None, str | None]]:
    """path and both values, as JSON text, of what differs between two parsed documents; None: not there."""
    stack, top = [("", a, b)], True
    while stack:
        path, a, b = stack.pop()
        open_a, open_b = _holds_more(a, flat, top), _holds_more(b, flat, top)
        top = False
        if open_a and open_b and type(a) is type(b):
            sides = [(a, b)]
        else:  # each by itself
            leaf = [_NOTHING if o else v for o, v in ((open_a, a), (open_b, b))]
            if leaf[0] is not _NOTHING or leaf[1] is not _NOTHING:
                yield path, _json(leaf[0]), _json(leaf[1])
            sides = [x for x in ((a, type(a)()) if open_a else None, (type(b)(), b) if open_b else None) if x]
        for one, two in sides:
            if isinstance(one, list):
                inside = [(f"{path}[{i}]", v, w) for i, (v, w) in enumerate(zip_longest(one, two, fillvalue=_NOTHING)) if v != w]
            else:
                before = f"{path}." if path else ""
                inside = [(before + k, v, two.get(k, _NOTHING)) for k, v in one.items() if v != two.get(k, _NOTHING)]
                inside += [(before + k, _NOTHING, w) for k, w in two.items() if k not in one]
            for item in inside:
                if isinstance(item[1], (dict, list)) or isinstance(item[2], (dict, list)):
                    stack.append(item)
                else:
                    yield item[0], _json(item[1]), _json(item[2])


def _number(text: str) -> tuple[str]:
    """A number as it is written; equal to no string."""
    return (text,)


def _holds_more(value: object, flat: bool, top: bool) -> bool:
    if isinstance(value, dict):
        return bool(value) and not (flat and not top and all(isinstance(v, str) for v in value.values()))
    return isinstance(value, list) and bool(value) and not flat


def _json(value: object) -> str | None:
    """JSON text as Spark writes it; None for what is not there."""
    if isinstance(value, tuple):
        return value[0]
    if isinstance(value, str):
        text = encode_basestring(value)
        return re.sub(r"(\\\\)|(\\u00..)", lambda m: m[1] or "\\u" + m[2][2:].upper(), text) if "\\u00" in text else text
    if isinstance(value, dict):
        return "{" + ",".join(f"{_json(k)}:{_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_json, value)) + "]"
    return None if value is _NOTHING else "null" if value is None else "true" if value else "false"


def nodes(docs: DataFrame, key: str, top: Column, children: str = "children") -> DataFrame:
    """key, id, parent, level (from 1), place (from 0 among its siblings), weight, node (variant) of nested nodes of any depth.

    top: the array (variant) of the first level's nodes. Nodes without an id go with
    all below them. A missing weight (or 0) is the number of kept nodes in the
    sibling subtrees before it.
    """
    use_shared_checkpoints(docs.sparkSession)
    level = docs.select(key, F.lit(None).cast("string").alias("parent"), F.array().cast("array<int>").alias("at"), top.alias("list"))
    levels = []
    while True:
        items = F.when(_is(F.col("list"), "ARRAY"), F.try_variant_get("list", "$", ITEMS))
        each = level.select(key, "parent", "at", F.posexplode(items).alias("i", "node"))
        named = each.filter(_is(F.col("node"), "OBJECT")).withColumn("id", F.trim(F.try_variant_get("node", "$.id", "string"))).filter("id <> ''")
        level = named.select(key, "id", "parent", F.array_append("at", F.col("i")).alias("at"), "node", F.try_variant_get("node", f"$.{children}", "variant").alias("list")).checkpoint()
        if level.isEmpty():
            break
        levels.append(level.drop("list"))
        level = level.select(key, F.col("id").alias("parent"), "at", "list")
    if not levels:
        levels = [level.drop("list")]
    found = reduce(DataFrame.unionByName, levels)
    # every node counts once for each of its places above it, its own included
    inside = found.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("at")), lambda n: F.slice("at", F.lit(1), n))).alias("at")).groupBy(key, "at").agg(F.count("*").alias("size"))
    before = Window.partitionBy(key, F.slice("at", F.lit(1), F.size("at") - 1)).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counted = found.join(inside, [key, "at"]).withColumn("running", F.coalesce(F.sum("size").over(before), F.lit(0)))
    given = F.try_variant_get("node", "$.weight", "int")
    return counted.select(key, "id", "parent", F.size("at").alias("level"), F.element_at("at", -1).alias("place"), F.when(F.coalesce(given, F.lit(0)) != 0, given).otherwise(F.col("running")).cast("int").alias("weight"), "node")


def _from_yaml(text: Column) -> Column:
    """JSON text of YAML text, by the YAML library if there is one."""

    @F.udf("string")
    def converted(t):
        import json

        import yaml

        return None if t is None else json.dumps(yaml.safe_load(t))

    return converted(text)


def taxonomy_file(spark: SparkSession, path: str) -> DataFrame:
    """path, taxonomy_id, label, languages, vocabulary, id, parent, level, place, weight, slug, name_fr, name_en, name_ar of JSON or (by suffix) YAML taxonomies of any depth, with defaults for what is missing."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    as_json = F.col("value")
    if path.endswith((".yaml", ".yml")):
        as_json = _from_yaml(as_json)
    docs = files.select("path", F.parse_json(as_json).alias("doc"))
    get = lambda v, p, kind="string": F.try_variant_get(v, p, kind)
    heads = docs.select("path", F.coalesce(get("doc", "$.taxonomy_id"), F.lit("universal_v0")).alias("taxonomy_id"), F.coalesce(get("doc", "$.label"), F.lit("Taxonomie universelle v0")).alias("label"), F.coalesce(get("doc", "$.languages", "array<string>"), F.array(F.lit("fr"), F.lit("en"), F.lit("ar"))).alias("languages"))
    each = docs.select("path", F.posexplode(get("doc", "$.vocabularies", ITEMS)).alias("v", "vocabulary")).withColumn("of", F.struct("path", "v"))
    found = nodes(each, "of", get("vocabulary", "$.terms", "variant"))
    names = each.select("of", get("vocabulary", "$.id").alias("vocabulary"))
    n = lambda k: get("node", f"$.{k}")
    return found.join(names, "of").join(heads.withColumnRenamed("path", "p"), F.col("of.path") == F.col("p")).select(
        F.col("p").alias("path"), "taxonomy_id", "label", "languages", "vocabulary", "id", "parent", "level", "place", "weight",
        F.coalesce(n("slug"), "id").alias("slug"), F.coalesce(n("name_fr"), "id").alias("name_fr"), F.coalesce(n("name_en"), "id").alias("name_en"), F.coalesce(n("name_ar"), n("name_en"), "id").alias("name_ar"),
    )


def tree_faults(rows: DataFrame) -> DataFrame:
    """id, fault: blank ids, ids that occur twice, parents that are missing, and nodes that no root leads to (cycles)."""
    from tessella.operators import trees

    blank = rows.filter("id is null or trim(id) = ''").select("id", F.lit("blank").alias("fault"))
    named = rows.filter("trim(id) <> ''")
    twice = named.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated").alias("fault"))
    lost = trees.orphans(named).select("id", F.lit("orphan").alias("fault"))
    reached = trees.walk(named.dropDuplicates(["id"])).select("id").distinct()
    below_lost = trees.walk(named.dropDuplicates(["id"]), lost).select("id").distinct()
    cyclic = named.select("id").distinct().join(reached, "id", "left_anti").join(below_lost, "id", "left_anti").select("id", F.lit("cycle").alias("fault"))
    return reduce(DataFrame.unionByName, [blank, twice, lost, cyclic]).distinct()


def replace_tree(current: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table after replacing a whole tree (id, parent, ...), and the outcome of each row: id, step, outcome.

    The new tree is taken as a whole or not at all. If it is sound, its nodes go in
    parent first (`step` is their level) and the old ones go first (`deleted`, step
    0). Otherwise the current table stays and the faulty nodes are `refused: ...`.
    """
    from tessella.operators import trees

    use_shared_checkpoints(new.sparkSession)
    faults = tree_faults(new).checkpoint()
    if not faults.isEmpty():
        return current, faults.select("id", F.lit(0).alias("step"), F.concat(F.lit("refused: "), "fault").alias("outcome"))
    steps = trees.walk(new).select("id", F.col("level").alias("step"), F.lit("inserted").alias("outcome"))
    return new.select(*current.columns), current.select("id", F.lit(0).alias("step"), F.lit("deleted").alias("outcome")).unionByName(steps)
