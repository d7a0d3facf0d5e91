"""JSON text: translations, safe decoding, replies of language models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import is_blank


def i18n(c: Column, locale: str) -> Column:
    """Text of a locale; missing and bad JSON give ''."""
    return F.coalesce(F.get_json_object(c, f"$.{locale}"), F.lit(""))


def to_i18n(**by_locale: Column) -> Column:
    """JSON object of the non-blank locales; `{}` if none."""
    pairs = F.create_map(*(x for k, v in by_locale.items() for x in (F.lit(k), v)))
    return F.to_json(F.map_filter(pairs, lambda _, v: ~is_blank(v)))


def merge_fields(current: Column, proposed: Column, fields: list[str]) -> Column:
    """map<string, string>: current with only the named fields taken from proposed."""
    take = F.array(*(F.lit(f) for f in fields))
    empty = F.create_map().cast("map<string,string>")
    new = F.map_filter(F.coalesce(proposed, empty), lambda k, _: F.array_contains(take, k))
    old = F.map_filter(F.coalesce(current, empty), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    return F.map_concat(old, new)


def object_or_null(c: Column) -> Column:
    """Variant of a JSON object; anything else (bad text, arrays, scalars) gives null."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def without_think(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<think>.*?</think>", "")


def first_object(c: Column) -> Column:
    """From the first `{` to the brace that balances it; braces inside strings count too. Null if none balances."""
    start = F.instr(c, "{")
    chars = F.split(F.substring(c, start, F.length(c)), "")
    scan = F.aggregate(
        chars,
        F.named_struct(F.lit("depth"), F.lit(0), F.lit("n"), F.lit(0), F.lit("end"), F.lit(0)),
        lambda acc, x: F.named_struct(
            F.lit("depth"),
            acc["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0),
            F.lit("n"),
            acc["n"] + 1,
            F.lit("end"),
            F.when((acc["end"] == 0) & (x == "}") & (acc["depth"] == 1), acc["n"] + 1).otherwise(acc["end"]),
        ),
        lambda acc: acc["end"],
    )
    return F.when(start > 0, F.when(scan > 0, F.substring(c, start, scan)))


def reply_json(c: Column) -> Column:
    """JSON text in a model's reply: the whole, a fenced block, or the first balanced object."""
    clean = strip(without_think(c))
    fenced = strip(F.regexp_extract(clean, r"(?s)```(?:json)?\s*(.*?)```", 1))
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(ok(clean), ok(F.nullif(fenced, F.lit(""))), ok(first_object(clean)))


def unwrap_list(c: Column, keys: tuple[str, ...] = ("concepts", "suggestions", "results", "items", "terms")) -> Column:
    """JSON array text: the value itself if it is one, else that of the first key that holds one, else the first list of the object."""
    is_list = lambda x: F.when(F.trim(x).startswith("["), x)

    def held(fields: Column) -> Column:
        """An object is taken apart once; text that can't be is searched key by key."""
        named = [is_list(F.when(fields.isNotNull(), F.get(F.map_values(F.map_filter(fields, lambda name, _: name == k)), F.lit(0))).otherwise(F.get_json_object(c, f"$.{k}"))) for k in keys]
        return F.coalesce(*named, F.get(F.filter(F.map_values(fields), is_list_text), F.lit(0)))

    is_list_text = lambda v: F.trim(v).startswith("[")
    apart = F.transform(F.array(F.from_json(c, "map<string,string>")), held)
    return F.coalesce(is_list(c), F.get(apart, F.lit(0)))
