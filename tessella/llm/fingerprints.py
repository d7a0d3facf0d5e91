"""Operator 1: document fingerprints by a threshold-scaled sketch (DataFrame functions only).

A text's sketch keeps the hash of every distinct five-word shingle that lies
below a fixed fraction of the 64-bit range, the same for texts of every length.
Sketches of that kind merge by union, and the share of one sketch found in
another estimates containment without bias, also between documents of very
unequal length. The smallest hash of a text stays in any case, so that no text
with words has an empty sketch; it counts only where neither of two sketches
has a hash below the fraction, and then says whether the texts agree in it.

Cases: null text counts as empty. Texts without words have an empty sketch;
two of them have likeness 1, one of them and any other 0. Texts of one to four
words have one shingle, all their words. Repeated shingles count once.
Containment of a text that has no hash below the fraction is 1 for equal
sketches and else unknown (null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, parallelism, struct, words

SHINGLE_WORDS = 5
FRACTION = 4  # keep one hash in four
#: Largest hash of the lowest 1/FRACTION of the signed 64-bit range.
LIMIT = -(2**63) + 2**64 // FRACTION
#: doc_id ranges of the neighbour search: quantiles asked of Spark, and ranges per shuffle partition.
CUTS, RANGES_PER_PARTITION = 256, 16
_LOWEST = -(2**63)


def shingle_hashes(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """array<bigint>: sorted distinct hashes of the k-word shingles of a whole text."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    shingled = let(
        hashed,
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < k, F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " "))))
        .otherwise(F.transform(F.slice(h, F.lit(1), F.size(h) - (k - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))))),
    )
    return F.sort_array(F.array_distinct(shingled))


def scaled(hashes: Column) -> Column:
    return F.filter(hashes, lambda h: h < F.lit(LIMIT))


def _kept(hashes: Column) -> Column:
    """The sketch of sorted shingle hashes: those below the limit, else the smallest."""
    return let(hashes, lambda h: F.when(F.get(h, F.lit(0)) < F.lit(LIMIT), scaled(h)).otherwise(F.slice(h, 1, 1)))


def sketch(text: Column) -> Column:
    """array<bigint>, ascending."""
    return _kept(shingle_hashes(text))


def merge(a: Column, b: Column) -> Column:
    """Sketch of two texts' shingles together."""
    return _kept(F.sort_array(F.array_union(a, b)))


def _overlap(a: Column, b: Column, share: Callable[[Column], Column], none: Column) -> Column:
    """share(struct of a, b, both: hashes below the limit of each and of both); without any in either: 1 if equal, else `none`."""
    counted = let(scaled(a), lambda x: let(scaled(b), lambda y: struct(a=F.size(x), b=F.size(y), both=F.size(F.array_intersect(x, y)))))
    return let(counted, lambda n: F.when(a == b, F.lit(1.0)).when(n["a"] + n["b"] == 0, none).otherwise(share(n)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has (0 to 1; null: unknown)."""
    return _overlap(a, b, lambda n: F.when(n["a"] > 0, n["both"] / n["a"]), F.lit(None).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate from two sketches: shared hashes over all hashes below the limit (0 to 1)."""
    return _overlap(a, b, lambda n: n["both"] / (n["a"] + n["b"] - n["both"]), F.lit(0.0))


def as_text(s: Column) -> Column:
    """The sketch as a string: 16 hex digits a hash, ascending."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint (string) of each document; no shuffle."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), as_text(sketch(F.col("text"))).alias("fingerprint"))


def _ranges(rows: DataFrame, edges: list[int]) -> Column:
    """Number of the range that a row is in, from its id `at` and the hash `h` of its text; later ranges have larger (at, h).

    `edges` are quantiles of the ids, each range between two of them is cut evenly
    once more. An id that is several quantiles (null or repeated ids) has the
    ranges between them to itself, cut by the hash.
    """
    fine = max(1, -(-parallelism(rows.sparkSession) * RANGES_PER_PARTITION // CUTS))
    edge = F.lit(edges).cast("array<bigint>")
    below, upto = F.size(F.filter(edge, lambda e: e < F.col("at"))), F.size(F.filter(edge, lambda e: e <= F.col("at")))
    part = F.greatest(upto, F.lit(1))
    low, high = F.get(edge, part - 1).cast("double"), F.get(edge, part).cast("double")
    share = F.coalesce((F.col("at").cast("double") - low) / (high - low), F.lit(0.0))
    even = part * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor(share * fine)))
    spread = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    hot = (below + 1) * fine + F.floor(F.least(spread, F.lit(1 - 1e-9)) * (upto - below - 1) * fine)
    return F.when(upto - below > 1, hot).otherwise(even).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch and next_text, next_sketch: of the next document by descending doc_id, cyclically.

    The ids are cut into many ranges of about equal counts, so the neighbour
    search shuffles every text once and no task gets more than its ranges;
    sketches are made behind the shuffle. The first document of each range is
    also sent to the range before it, where it serves as the last one's neighbour
    only; the list of these has one id and hash per range, so its size is bounded
    by the number of partitions. Rows of equal doc_id follow each other by
    descending hash of the text, then text; null ids come last.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("at"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    cuts = rows.agg(F.percentile_approx("at", [i / CUTS for i in range(CUTS + 1)], 20_000)).first()[0]
    placed = rows.withColumn("bucket", _ranges(rows, sorted(cuts)) if cuts else F.lit(0).cast("long"))
    heads = placed.groupBy("bucket").agg(F.max(F.struct("at", "h")).alias("top"))
    # each range's first document also goes to the range before it in this order; the very first to the last range
    down = Window.orderBy(F.desc("bucket"))
    sent = heads.select("top.at", "top.h", F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(Window.partitionBy())).alias("to"))
    moved = placed.join(F.broadcast(sent), ["at", "h"], "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    flat = moved.select("doc_id", "at", "h", "text", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("p")).select("doc_id", "at", "h", "text", "p.bucket", "p.guest")
    sketched = flat.repartition("bucket").withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("at"), F.desc("h"), F.desc("text"))
    seen = sketched.withColumn("next", F.lead(F.struct("text", "sketch")).over(order)).filter("guest = 0")
    return seen.select("doc_id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """The contract of the query: every text, its edited text and the likeness of their sketches.

    Edited: the last floor(n_chars / 3) code points are replaced by the first as
    many (or all) of the next document. A table of one document is its own next.
    """
    n = F.length("text")
    tail = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail))
    pairs = with_next(docs).select("doc_id", "text", "sketch", "next_sketch", n.cast("long").alias("n_chars"), edited.alias("edited"))
    sketched = pairs.withColumn("edited_sketch", sketch(F.col("edited")))
    return sketched.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_in_edited"),
    )
