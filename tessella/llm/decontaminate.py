"""Operator 5: benchmark decontamination with a distributed positional inverted index.

The index holds the postings of all training tokens. It is split by document
into segments of bounded size: each row of the stored table is one segment, with
its sorted terms and, term by term, the sorted positions of their occurrences;
a file holds `FILE_SEGMENTS` of them, about 12 MB, so reading is bounded too.
Building it reads the texts once and shuffles nothing; postings of hot terms are
spread over the segments as the documents are. It is written to the shared
folder, so further blocks of test items and retried tasks read postings, not
texts.

All test windows are answered from each segment. A window is looked up from its
rarest term: the offset-adjusted positions of that term are the candidate
starts, which are then intersected with the lists of its other terms from rare
to frequent. Rarity is the length of the segment's own lists, so it is exact
where it is used.

Exact matches are places where a window's words stand consecutively. Proximity
matches are candidate starts where every other term occurs within `SLOP` words
of its place.

A window is `WINDOW` consecutive item words; an item of fewer words (but not
none) is one window. The items are read in blocks of at most `BLOCK_WORDS`
words, so what one lookup ships to the tasks has a fixed bound; further blocks
are further lookups in the index whose spans are merged. Words are 64-bit hashes.

Cases: null or wordless documents and items match nothing. Items with equal ids
count as one. Repeated documents are answered row by row. An empty benchmark
hits nothing. Overlapping occurrences hit a word once. Documents of equal or
null id are told apart by their text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import ensure_checkpoint_dir, pack, shared_folder, stored, struct, unpack, written

WINDOW = 10
SLOP = 2
#: Free positions between texts: no window, and no word near its place, reaches over them.
GAP = WINDOW + SLOP + 1
BLOCK_WORDS = 1_000_000
#: Candidate starts looked at together.
CANDIDATES = 2_000_000
#: Segments a file of the stored index: readers take a file's rows at once, whatever size a task's share of files has.
FILE_SEGMENTS = 4
#: So many contaminated documents (16 bytes each) at most are sent to all tasks.
SENT_IDS = 250_000

_ANSWER = ["segment", "text", "doc", "h", "n_words", "spans", "items", "near"]
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


class Lookup:
    """The windows of one block of items, as term numbers."""

    def __init__(self, items: list[tuple[str, str]]):
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            h = textnum.word_hash(text)
            size = min(WINDOW, len(h))
            for i in range(len(h) - size + 1 if size else 0):
                windows.setdefault(tuple(h[i : i + size].tolist()), set()).add(item)
        self.terms = np.array(sorted({t for w in windows for t in w}), np.uint64)
        self.items = sorted({i for s in windows.values() for i in s})
        number = {x: i for i, x in enumerate(self.items)}
        by_size: dict[int, list[tuple[int, ...]]] = {}
        for w in windows:
            by_size.setdefault(len(w), []).append(w)
        self.groups = []
        for size, rows in sorted(by_size.items()):
            owned = [[number[i] for i in sorted(windows[w])] for w in rows]
            matrix = np.searchsorted(self.terms, np.array(rows, np.uint64).reshape(-1, size))
            self.groups.append((size, matrix, np.cumsum([0, *map(len, owned)]), np.array([i for o in owned for i in o], np.int64)))

    def postings(self, s: Segment) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys term number * span + position of this block's terms, and the lengths of their lists."""
        at = np.minimum(np.searchsorted(s.terms, self.terms), max(len(s.terms) - 1, 0))
        lengths = np.where(s.terms[at] == self.terms, s.sizes[at], 0) if len(s.terms) else np.zeros(len(self.terms), np.int64)
        heads = np.cumsum(s.sizes) - s.sizes
        of = np.repeat(np.arange(len(self.terms)), lengths)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return of * s.span + s.places[heads[at[of]] + inner] if len(of) else of, lengths

    def find(self, s: Segment) -> tuple[np.ndarray, ...]:
        """(text, first word, size) of exact matches; (text, item) of exact and of proximity matches."""
        base, span = s.base, s.span
        keys, lengths = self.postings(s)
        heads = np.searchsorted(keys, np.arange(len(self.terms)) * span)
        places, exact, close = [], [], []
        for size, matrix, owned_at, owned in self.groups:
            alive = np.flatnonzero((lengths[matrix] > 0).all(axis=1))
            order = np.argsort(lengths[matrix[alive]], axis=1, kind="stable")
            anchor = matrix[alive, order[:, 0]] if len(alive) else alive
            total = np.cumsum(lengths[anchor]) if len(alive) else alive
            row = 0
            while row < len(alive):
                end = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + CANDIDATES, "right")))
                part = np.arange(row, end)
                reps = lengths[anchor[part]]
                which = np.repeat(part, reps)
                inner = np.arange(len(which)) - np.repeat(np.cumsum(reps) - reps, reps)
                start = keys[np.repeat(heads[anchor[part]], reps) + inner] - np.repeat(anchor[part], reps) * span - order[which, 0]
                for k in range(1, size):
                    key = matrix[alive[which], order[which, k]] * span + start + order[which, k]
                    near = np.searchsorted(keys, key + SLOP, "right") > np.searchsorted(keys, key - SLOP)
                    which, start = which[near], start[near]
                self._own(close, which, start + order[which, 0], alive, owned_at, owned, base)
                for k in range(1, size):
                    key = matrix[alive[which], order[which, k]] * span + start + order[which, k]
                    found = np.searchsorted(keys, key)
                    same = keys[np.minimum(found, len(keys) - 1)] == key
                    which, start = which[same], start[same]
                self._own(exact, which, start + order[which, 0], alive, owned_at, owned, base)
                text = np.searchsorted(base, start, "right") - 1
                places.append(np.stack([text, start - base[np.maximum(text, 0)], np.full(len(start), size)]))
                row = end
        join = lambda x, rows: np.concatenate(x, axis=1) if x else np.zeros((rows, 0), np.int64)
        return join(places, 3), np.unique(join(exact, 2), axis=1), np.unique(join(close, 2), axis=1)

    @staticmethod
    def _own(out: list, which, anchor, alive, owned_at, owned, base) -> None:
        n = owned_at[alive[which] + 1] - owned_at[alive[which]]
        text = np.maximum(np.searchsorted(base, anchor, "right") - 1, 0)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out.append(np.unique(np.stack([np.repeat(text, n), owned[np.repeat(owned_at[alive[which]], n) + inner]]), axis=1))

    def answer(self, s: Segment) -> list[pa.Array]:
        """n_words, spans, items, near of each text of a segment."""
        n = len(s.counts)
        if len(s.places) and len(self.terms):
            places, exact, close = self.find(s)
        else:
            places, exact, close = np.zeros((3, 0), np.int64), np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64)
        first = np.cumsum(s.counts) - s.counts
        change = np.zeros(int(s.counts.sum()) + n + 1, np.int64)  # one free place after each text
        at = first[places[0]] + places[0] + places[1]
        np.add.at(change, at, 1)
        np.add.at(change, at + places[2], -1)
        hit = np.cumsum(change) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit])))
        start, stop = edge[::2], edge[1::2]
        origin = first + np.arange(n)
        text = np.searchsorted(origin, start, "right") - 1
        from_text = origin[text] if len(text) else text
        spans = pa.StructArray.from_arrays([pa.array(start - from_text, pa.int64()), pa.array(stop - from_text, pa.int64())], fields=list(_SPAN))
        lists = lambda owner, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)
        names = np.array(self.items, object)
        named = lambda pairs: lists(pairs[0], pa.array(names[pairs[1]] if len(names) else [], pa.string()))
        return [pa.array(s.counts, pa.int64()), lists(text, spans), named(exact), named(close)]


@dataclass
class Segment:
    """Postings of some texts: sorted terms, how often each occurs, positions term by term; and the texts' numbers of words.

    Texts lie one behind the other, with a gap between that no window bridges.
    """

    terms: np.ndarray
    sizes: np.ndarray
    places: np.ndarray
    counts: np.ndarray

    @property
    def base(self) -> np.ndarray:
        """Position of each text's first word."""
        return np.cumsum(self.counts) - self.counts + GAP * (np.arange(len(self.counts)) + 1)

    @property
    def span(self) -> int:
        return int(self.counts.sum() + GAP * (len(self.counts) + 3))


def segment(texts: pa.Array) -> Segment:
    w = textnum.words(texts)
    at = np.arange(len(w.hash)) + np.repeat(GAP * (np.arange(len(w.counts)) + 1), w.counts)
    order = np.argsort(w.hash, kind="stable")
    terms, sizes = np.unique(w.hash, return_counts=True)
    return Segment(terms, sizes, at[order], w.counts)


def index(docs: DataFrame) -> DataFrame:
    """The stored index of docs: a row a segment, its texts named by doc (null doc_id: null) and h (hash of the text)."""

    def build(batches):
        for batch in batches:
            for a, b in textnum.slices(batch.column(2)):
                s = segment(batch.column(2)[a:b])
                one = lambda values, kind: pa.array([values], pa.list_(kind))
                listed = lambda column: pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), column[a:b])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [listed(batch.column(0)), listed(batch.column(1)), one(s.counts, pa.int32()), one(s.terms.view(np.int64), pa.int64()), one(s.sizes, pa.int32()), one(s.places, pa.int32())],
                    ["doc", "h", "counts", "terms", "sizes", "places"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("h"), "text")
    path = stored(f"{shared_folder(docs.sparkSession)}/postings-{uuid.uuid4().hex}")
    rows.mapInArrow(build, "doc array<long>, h array<long>, counts array<int>, terms array<long>, sizes array<int>, places array<int>").write.option("maxRecordsPerFile", FILE_SEGMENTS).parquet(path)
    return docs.sparkSession.read.parquet(path)


def _blocks(items: DataFrame) -> Iterator[Lookup]:
    """The items in blocks of about BLOCK_WORDS words; one empty block without items."""
    block, held, made = [], 0, 0
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").filter("text is not null").orderBy("item", "text")
    for r in rows.toLocalIterator():
        block.append((r.item, r.text))
        held += len(textnum.words(pa.array([r.text])).hash) + 1
        if held >= BLOCK_WORDS:
            yield Lookup(block)
            block, held, made = [], 0, made + 1
    if block or not made:
        yield Lookup(block)


def _answers(index: DataFrame, lookup: Lookup) -> DataFrame:
    """segment, text, doc, h and what the windows of one block hit, a row for each text."""

    def look_up(batches):
        for batch in batches:
            flat = lambda name, i: np.asarray(batch.column(name)[i].values)  # noqa: E731, B023
            for i in range(batch.num_rows):
                s = Segment(flat("terms", i).view(np.uint64), flat("sizes", i).astype(np.int64), flat("places", i).astype(np.int64), flat("counts", i).astype(np.int64))
                n = len(s.counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column("segment")[i].as_py())), pa.array(np.arange(n)), batch.column("doc")[i].values, batch.column("h")[i].values, *lookup.answer(s)], _ANSWER)

    # segments are told apart by what they hold
    named = index.select(F.xxhash64("doc", "h", "counts").alias("segment"), "*")
    return named.mapInArrow(look_up, "segment long, text long, doc long, h long, n_words long, spans array<struct<start:bigint,stop:bigint>>, items array<string>, near array<string>")


def _hits(spans: Column) -> Column:
    """Number of words in the union of sorted spans."""
    return F.aggregate(
        spans,
        struct(stop=F.lit(0).cast("long"), n=F.lit(0).cast("long")),
        lambda acc, s: struct(stop=F.greatest(acc["stop"], s["stop"]), n=acc["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], acc["stop"]))),
        lambda acc: acc["n"],
    )


def search(index: DataFrame, items: DataFrame) -> DataFrame:
    """doc, h, n_words, spans, items and near (sorted) of each indexed text, over all blocks of items.

    One block is answered where the index is read. Of several, the driver holds one
    or two at a time: the answers of each are stored before the next is read, of
    all but the first the hits alone.
    """
    blocks = _blocks(items)
    first, second = next(blocks), next(blocks, None)
    answers = _answers(index, first)
    if second is None:
        return answers.select("doc", "h", "n_words", "spans", F.sort_array("items").alias("items"), F.sort_array("near").alias("near"))
    found = [written(answers.withColumn("first", F.lit(True)))]
    del first, answers
    hit = (F.size("spans") > 0) | (F.size("items") > 0) | (F.size("near") > 0)
    while second is not None:
        found.append(written(_answers(index, second).filter(hit).withColumn("first", F.lit(False))))
        second = next(blocks, None)
    # equal segments hold equal rows: their answers are merged and given as often as there are rows
    merged = lambda name: F.flatten(F.collect_list(name))
    every = reduce(DataFrame.unionByName, found).groupBy("segment", "text", "doc", "h", "n_words").agg(merged("spans").alias("spans"), merged("items").alias("items"), merged("near").alias("near"), F.count_if("first").cast("int").alias("times"))
    once = every.select("doc", "h", "n_words", F.sort_array("spans").alias("spans"), F.sort_array(F.array_distinct("items")).alias("items"), F.sort_array(F.array_distinct("near")).alias("near"), "times")
    return once.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: its hit words, the items whose windows occur, and those near by."""
    return search(index(docs), benchmark).select(
        F.col("doc").alias("doc_id"),
        "n_words",
        _hits(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near_items"),
        F.to_json("spans").alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, in which no window of the benchmark occurs."""
    ensure_checkpoint_dir(docs.sparkSession)
    last = F.lit(2**63 - 1)
    hit = search(index(docs), benchmark).filter(F.size("items") > 0).select(F.coalesce("doc", last).alias("doc"), "h").distinct().checkpoint()
    packed = pack(docs, doc=F.coalesce(F.col("doc_id").cast("long"), last), h=F.xxhash64("text"))
    few = hit.count() <= SENT_IDS  # else the rows meet them in a shuffle
    return unpack(packed.join(F.broadcast(hit) if few else hit, ["doc", "h"], "left_anti"))
