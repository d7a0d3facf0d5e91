"""Operator 13: fill-in-middle transformation in an Arrow-batched pandas UDF.

A text is cut into units (code points; any regular expression that covers each
text without gaps may be given, such as `\\X` or `\\s*\\S+\\s*`). The end offsets of
its units stand in one compact array; two look-ups there slice the text into
prefix, middle and suffix. Which cut and which form a document gets depends on
the SHA-256 of a salt and its id alone, so every run and partitioning gives the
same.

Forms: `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle,
`plain` leaves the text alone. A text that holds one of the marks stays plain, so
`restored` finds the marks of the output and rebuilds the exact text from output
and form. (A mark cannot come about at a seam: it would have to begin inside a
text with `<` and go on with a mark's own `<`.)

Cases: a null text counts as empty and stays plain; a null id is seeded as the
empty string. Rows that are repeated get the same output. Columns of the input
are carried along, except those named as an added one. Empty tables give no
rows. A text is one value, so a task holds a few batches of texts; very long ones
take four bytes a unit beside their text.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINT = r"(?s)."
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are transformed, and of these in the form spm.
TRANSFORMED, SUFFIX_FIRST = 90, 20
ADDED = "form string, n long, prefix_chars long, middle_chars long, output string, output_sha256 string"


def seeds(salt: str, doc_id: str | None) -> tuple[int, int, int, int]:
    """The first four groups of eight hex digits of the digest of `salt:id`."""
    digest = hashlib.sha256(f"{salt}:{doc_id or ''}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def unit_ends(pattern: regex.Pattern, text: str) -> array:
    """End offsets of the units, after a 0."""
    ends = array("I", [0])
    ends.extend(m.end() for m in pattern.finditer(text))
    return ends


def transformed(text: str, doc_id: str | None, pattern: regex.Pattern, salt: str, rate: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """form, units, code points of prefix and middle, output."""
    ends = unit_ends(pattern, text)
    n = len(ends) - 1
    if ends[-1] != len(text):
        raise ValueError("the units do not cover the text")
    h1, h2, h3, h4 = seeds(salt, doc_id)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", n, None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[low], ends[high]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return "spm", n, a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return "psm", n, a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def transform(docs: DataFrame, unit: str = CODE_POINT, salt: str = "1", rate: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with form, n (units), prefix_chars, middle_chars (code points, null if plain), output and its output_sha256."""

    @F.pandas_udf(ADDED)
    def fill(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(unit)
        rows = [transformed(text, doc_id, pattern, salt, rate, suffix_first) for doc_id, text in zip(ids, texts)]
        out = pd.DataFrame(rows, columns=["form", "n", "prefix_chars", "middle_chars", "output"])
        out["prefix_chars"], out["middle_chars"] = out["prefix_chars"].astype("Int64"), out["middle_chars"].astype("Int64")
        out["output_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in out["output"]]
        return out

    names = [x.split()[0] for x in ADDED.split(", ")]
    kept = [docs[f"`{c}`"] for c in docs.columns if c not in names]
    filled = docs.select(F.struct(*kept).alias("row"), fill(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).alias("fim"))
    return filled.select("row.*", "fim.*")


def restored(output: Column, form: Column) -> Column:
    """The text that `transform` was given, from its output and form alone."""

    def between(left: str, right: str) -> Column:
        start = F.instr(output, left) + F.lit(len(left))
        return F.substring(output, start, F.instr(output, right) - start)

    middle = F.substring(output, F.instr(output, MIDDLE) + F.lit(len(MIDDLE)), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The contract of the query: sizes and digests of outputs and of the texts rebuilt from them."""
    out = transform(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
        F.sha2(F.encode(restored(F.col("output"), F.col("form")), "UTF-8"), 256).alias("restored_sha256"),
    )
