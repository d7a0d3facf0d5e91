"""Operator 6: substring dedup by line hashing.

A text is cut into units: lines, and within lines sentences (after `.`, `!` or
`?` and a blank). A unit is normalised to its words, lower-cased, and hashed to
128 bits in their order. Digests are grouped over all documents; the earliest
ranked document (smallest doc_id, then smallest hash of the text) keeps its first occurrence, every later
occurrence is marked. Runs of marked units of at least `min_words` words
together are removed. With min_words=1 every later occurrence goes. The default,
`MIN_WORDS`, removes repeated passages and leaves the stock lines and short
sentences that unrelated documents share. Offsets of what was removed refer to
the original text.

Only digests are shuffled: each document sends a distinct digest once, Spark
takes the smallest and largest rank a digest (partial sums before the
shuffle, so frequent lines do not gather), and a join with the digests of more
than one document, which adaptive execution can split, marks the later ones.

Cases: null stays null and has no units; units without words are no units and
do not end a run. Within one text the first of equal units is kept. Rows of
equal doc_id or of null doc_id (ranked last) are told apart by their text; rows
equal in both rank equal, and none loses a unit to the other. Empty tables give no rows. Extra columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import owners, pack, unpack

MIN_WORDS = 25
_LAST = 2**63 - 1
_TYPE = "struct<text:string,n_units:bigint,n_removed:bigint,removed_chars:bigint,spans:string>"


class Units:
    """Units of the texts of a slice: numbers per unit, texts in order."""

    def __init__(self, w: textnum.Words):
        data, owner = w.data, owners(w)
        ends = np.flatnonzero(data == 10)
        stop = np.flatnonzero(((data == 46) | (data == 33) | (data == 63))[:-1] & ((data[1:] == 32) | (data[1:] == 9))) + 1 if len(data) > 1 else ends[:0]
        cuts = np.union1d(np.union1d(ends, stop), w.offsets[1:-1]) if len(w.offsets) > 2 else np.union1d(ends, stop)
        part = np.searchsorted(cuts, w.start, "right")
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
        self.at = np.flatnonzero(new)
        self.words = np.diff(np.append(self.at, len(part)))
        place = (np.arange(len(part)) - np.repeat(self.at, self.words) + 1).astype(np.uint64)
        if len(self.at):
            one = np.add.reduceat(textnum.mix(w.hash + place * np.uint64(0x9E3779B97F4A7C15)), self.at)
            two = np.add.reduceat(textnum.mix((w.hash ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB) + place * np.uint64(0x8EBC6AF09C88C6E3)), self.at)
        else:
            one = two = np.zeros(0, np.uint64)
        self.d1, self.d2 = textnum.mix(one).view(np.int64), textnum.mix(two + np.uint64(1)).view(np.int64)
        self.owner = owner[self.at]
        self.begin = w.start[self.at]  # byte of the first word
        self.first = np.searchsorted(self.owner, np.arange(len(w.first)))

    def earlier_here(self) -> np.ndarray:
        """Whether the same unit stands earlier in the same text."""
        order = np.lexsort((np.arange(len(self.d1)), self.d2, self.d1, self.owner))
        d1, d2, o = self.d1[order], self.d2[order], self.owner[order]
        again = np.zeros(len(order), bool)
        again[order[1:]] = (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1]) & (o[1:] == o[:-1])
        return again


def unit_digests(docs: DataFrame) -> DataFrame:
    """doc (null doc_id: largest), h (hash of the text), unit, d1, d2: each distinct unit of each document once."""

    def cut(batches):
        for batch in batches:
            ids, hashes, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2)
            for a, b in textnum.slices(texts, textnum.WORK_BYTES):
                u = Units(textnum.words(texts[a:b]))
                keep = ~u.earlier_here()
                unit = np.arange(len(u.owner)) - u.first[u.owner]
                of = u.owner[keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][of], pa.int64()), pa.array(hashes[a:b][of], pa.int64()), pa.array(unit[keep], pa.int32()), pa.array(u.d1[keep]), pa.array(u.d2[keep])], ["doc", "h", "unit", "d1", "d2"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(cut, "doc long, h long, unit int, d1 long, d2 long")


def later_units(docs: DataFrame) -> DataFrame:
    """doc, h, units array<int>: the units of a document that stand in an earlier ranked one."""
    units = unit_digests(docs)
    rank = F.struct("doc", "h")
    shared = units.groupBy("d1", "d2").agg(F.min(rank).alias("keeper"), F.max(rank).alias("last")).filter("keeper < last").select("d1", "d2", "keeper")
    marked = units.join(shared, ["d1", "d2"]).filter(rank > F.col("keeper"))
    return marked.groupBy("doc", "h").agg(F.collect_set("unit").alias("units"))


def _remove(text: Column, units: Column, min_words: int) -> Column:
    @F.arrow_udf(_TYPE)
    def removed(texts: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for a, b in textnum.slices(texts, textnum.WORK_BYTES):
            out += _removed(texts[a:b], marks[a:b], min_words)
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in out], pa.string()), *(pa.array([r[i] for r in out], pa.int64()) for i in (1, 2, 3)), pa.array([r[4] for r in out], pa.string())],
            ["text", "n_units", "n_removed", "removed_chars", "spans"],
        )

    return removed(text, units)


def _removed(texts: pa.Array, marks: pa.Array, min_words: int) -> list[tuple]:
    w = textnum.words(texts)
    u = Units(w)
    marked = u.earlier_here()
    kept_as_is = texts.to_pylist()
    out = []
    for i, (text, mark) in enumerate(zip(kept_as_is, marks.to_pylist(), strict=True)):
        lo, hi = int(u.first[i]), int(u.first[i + 1])
        if mark:
            own = np.zeros(hi - lo, bool)
            at = np.array(mark)
            own[at[at < hi - lo]] = True
            # a unit repeated here has the digest of its first occurrence, which alone was sent
            digest = np.rec.fromarrays([u.d1[lo:hi], u.d2[lo:hi]])
            flag = marked[lo:hi] | np.isin(digest, digest[own]) if marked[lo:hi].any() else own
        else:
            flag = marked[lo:hi]
        runs = []
        if flag.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]])))
            runs = [(x, y) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if u.words[lo + x : lo + y].sum() >= min_words]
        if not runs:
            out.append((text, hi - lo, 0, 0, ""))
            continue
        start, stop = int(w.offsets[i]), int(w.offsets[i + 1])
        raw = w.data[start:stop].tobytes()
        pieces, spans, at, gone = [], [], 0, 0
        for x, y in runs:
            begin = int(u.begin[lo + x]) - start
            end = int(u.begin[lo + y]) - start if lo + y < hi else len(raw)
            pieces.append(raw[at:begin])
            first = len(raw[:begin].decode())
            length = len(raw[begin:end].decode())
            spans.append(f"{first}-{first + length}")
            gone += length
            at = end
        pieces.append(raw[at:])
        out.append((b"".join(pieces).decode(), hi - lo, sum(y - x for x, y in runs), gone, ",".join(spans)))
    return out


def _deduplicated(docs: DataFrame, min_words: int) -> DataFrame:
    """row (all columns of docs) and r (what _remove returns)."""
    packed = pack(docs, doc=F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), h=F.xxhash64("text"), text=F.col("text"))
    joined = packed.join(later_units(docs), ["doc", "h"], "left")
    return joined.select("row", _remove(F.col("text"), F.col("units"), min_words).alias("r"))


def dedup_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without later occurrences, and what was removed (spans: code points `from-to` of the original)."""
    return _deduplicated(docs.select("doc_id", "text"), min_words).select("row.doc_id", "r.text", "r.n_units", "r.n_removed", "r.removed_chars", "r.spans")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of docs; text without later occurrences, n_chars (if there) to match."""
    text = F.col("r.text")
    fresh = {"text": text, "n_chars": F.length(text).cast("long")}
    fields = [fresh.get(c, F.col("row")[c]).cast(t).alias(c) for c, t in docs.dtypes]
    return _deduplicated(docs, min_words).select(*fields)
