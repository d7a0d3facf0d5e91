"""Missing values, safe casts, search and number helpers.

"Blank" follows the truthiness of the data's producers: null, '' and 0 count as
missing there, so a bare coalesce would keep too much.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def first_nonblank(*columns: Column) -> Column:
    """The first column that is neither null nor the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def positive_or(c: Column, default: int) -> Column:
    """c, or the default where c is null or 0."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def to_int(c: Column) -> Column:
    """Safe integer cast: null and garbage give 0."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def to_double(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def all_of(conditions: Iterable[Column]) -> Column:
    """Conjunction of the conditions that were given; true when there are none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def null_or_until(c: Column, limit: Column) -> Column:
    return c.isNull() | (c <= limit)


def matches_any(query: str, *columns: Column) -> Column:
    """Case-insensitive substring in any column; an empty query matches nothing, `%` and `_` stay wildcards."""
    if not query:
        return F.lit(False)
    return reduce(lambda a, b: a | b, (F.lower(c).like(f"%{query.lower()}%") for c in columns))


def unknown_items(items: Column, known: Iterable[str]) -> Column:
    """Sorted distinct items outside a vocabulary."""
    return F.array_sort(F.array_except(items, F.array(*(F.lit(k) for k in known))))


def missing_fields(**fields: Column) -> Column:
    """Names of the fields that are blank, in the given order."""
    return F.array_compact(F.array(*(F.when(is_blank(c), F.lit(name)) for name, c in fields.items())))


def safe_path_part(c: Column) -> Column:
    return c.rlike(r"^[a-zA-Z0-9._-]+$") & ~c.isin(".", "..")


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounding to even halves."""
    return F.bround(c, digits)


def clean_list(items: Column) -> Column:
    """Trimmed items without blanks and repetitions, in first-seen order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def by_length(items: Column, low: int = 2, high: int = 30) -> Column:
    return F.filter(items, lambda x: (F.length(x) >= low) & (F.length(x) <= high))


# order statistics of a sorted array


def index_median(sorted_values: Column) -> Column:
    """Upper median: the element at n // 2, not interpolated."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) / 2).cast("int"))


def index_quantile(sorted_values: Column, q: float) -> Column:
    """The element at int(n * q)."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) * F.lit(q)).cast("int"))


def rank_quantile(sorted_values: Column, q: float) -> Column:
    """The element at the half-even rounded rank q * (n - 1)."""
    return F.get(sorted_values, F.bround(F.lit(q) * (F.size(sorted_values) - 1), 0).cast("int"))


# times as text


def parse_utc(c: Column) -> Column:
    """ISO-8601 text with `Z` or an offset to a timestamp; garbage gives null."""
    return F.try_to_timestamp(c)


def duration_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(parse_utc(end)) - F.unix_millis(parse_utc(start))


def as_utc_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: Seconds to wait before retry 1, 2 and any later one.
RETRY_SECONDS = (60, 300, 900)


def retry_delay(retries: Column) -> Column:
    return F.get(F.array(*(F.lit(s) for s in RETRY_SECONDS)), F.least(retries, F.lit(len(RETRY_SECONDS) - 1)).cast("int"))
