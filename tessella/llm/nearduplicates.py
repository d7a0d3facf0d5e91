"""Operator 9: near-duplicate detection by Order MinHash and banded alignment.

Texts are sequences of five-word shingles (k-mers), each labelled with its
occurrence number in the text, so that repeated k-mers stay apart. An Order
MinHash sketch takes the two labelled k-mers of smallest hash and keeps their
order in the text: two texts agree in it when they share these k-mers in that
order, which falls with every edit. `SKETCHES` independent sketches are joined
in bands of `ROWS`; texts that agree in a band are candidates. At similarity
0.8 a band agrees with chance 0.41, one of the twelve with 0.998.

Candidates are verified by banded alignment: the labelled k-mers that both
texts have are aligned in order (longest increasing subsequence) inside the
diagonal band that a pair of the wanted similarity cannot leave. Similarity is
aligned k-mers over all k-mers of the two texts together, at least
`SIMILARITY`.

Scale. Equal word sequences collapse to one content first, by digest. Then each
text of a band group is compared with the group's lead, the member in most
company over all bands, which is the text that the others are copies of: first
with the lead it shares most bands with, then, while they are in different
classes, with its others. This joins most copies without expanding a group into
its pairs. Then nothing that can be alike stays open: the texts of all groups
meet by prefix filter. The labelled k-mers of every text are put into one order,
common ones last; two texts of the wanted similarity share one of the first
`n - ceil(wanted * n) + 1` k-mers of each. Pairs in different classes that do,
and whose sizes and places allow enough shared k-mers, are all verified, some
for each text and class at first, so that classes that merge spare the rest.
So any two texts that are in band groups and alike end up in one class. Pairs
that share only common words of a family meet late in the order, not at all.
Classes are the connected components of the links. Groups are keys of
joins and sums only; no group is collected. Lineage is cut with checkpoint().

Cases: null and wordless texts are near-duplicates of equal raw text only
(null counts as empty). Texts of up to five words have one k-mer, so they match
equal words only. Rows are told apart by doc_id and text, so different texts
under one doc_id, or without one, have classes of their own. A class is named by
its smallest doc_id (null if it has none) and kept by the row of smallest doc_id
(null last), then smallest hash of the text. An empty table gives no rows.
Contents are named by 64 bits of their digest while they are linked.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textnum
from .common import ensure_checkpoint_dir, pack, unpack, written

K = 5
SIMILARITY = 0.8
SKETCHES, ROWS = 24, 2
BANDS = SKETCHES // ROWS
#: So many k-mers at most are sent to all tasks as common ones (16 bytes each), each in more than COMMON of the COUNTED texts (one in so many).
COMMON_KMERS, COMMON, COUNTED = 250_000, 2, 8
#: Pairs verified for each text and other class in the first round of the exact search; BATCH times as many in each later round.
BATCH = 8
#: So many ids (8 bytes each) at most are sent to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 250_000
_LAST = 2**63 - 1
LINKS_PER_PARTITION = 100_000

_SEEDS = textnum.mix(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _ODD = _SEEDS[:SKETCHES, None], _SEEDS[SKETCHES:, None] | np.uint64(1)


def labelled_kmers(hashes: np.ndarray) -> np.ndarray:
    """Occurrence-labelled k-mer hashes of a text, in text order; all distinct."""
    k = textnum.kmers(hashes, K)
    order = np.argsort(k, kind="stable")
    s = k[order]
    same = np.zeros(len(k), bool)
    same[1:] = s[1:] == s[:-1]
    if not same.any():
        return k
    place = np.arange(len(k))
    occurrence = np.empty(len(k), np.int64)
    occurrence[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    return np.where(occurrence > 0, textnum.mix(k + occurrence.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), k)


def sketch(kmers: np.ndarray) -> np.ndarray:
    """SKETCHES Order MinHash values of a text (none without k-mers)."""
    n = len(kmers)
    if not n:
        return np.zeros(0, np.uint64)
    h = (kmers[None, :] ^ _XOR) * _ODD
    h ^= h >> np.uint64(29)
    if n > 2:
        low = np.sort(np.argpartition(h, 1, axis=1)[:, :2], axis=1)
    else:
        low = np.broadcast_to(np.arange(n), (SKETCHES, n))
    picked = kmers[low]
    if picked.shape[1] == 1:
        return picked[:, 0]
    return textnum.mix(picked[:, 0] * np.uint64(0x9E3779B97F4A7C15) + picked[:, 1])


def bands(rows: int, count: int) -> list[list[int]]:
    """Which sketches each of `count` keys of `rows` sketches takes: disjoint while there are enough, then drawn."""
    if rows * count <= SKETCHES:
        return [list(range(i * rows, (i + 1) * rows)) for i in range(count)]
    draw = np.random.default_rng(9)
    return [sorted(draw.choice(SKETCHES, rows, replace=False).tolist()) for _ in range(count)]


def band_keys(sketch_column: Column, rows: int, count: int) -> Column:
    """array<bigint>: one key a band."""
    return F.array(*(F.xxhash64(F.lit(k), *(F.get(sketch_column, F.lit(i)) for i in band)) for k, band in enumerate(bands(rows, count))))


def aligned_similarity(a: np.ndarray, b: np.ndarray, wanted: float = SIMILARITY) -> float:
    """Aligned labelled k-mers over all of both; exact where it is at least `wanted`, else a lower bound."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), m - 1)
    there = order[at]
    i = np.flatnonzero(b[there] == a)
    j = there[i]
    band = int((n + m) * (1 - wanted) / (1 + wanted)) + 1
    j = j[np.abs(i - j) <= band]
    shared = len(j)
    if shared / (n + m - shared) < wanted:
        return shared / (n + m - shared)
    if not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():
            p = bisect_left(tails, x)
            tails[p : p + 1] = [x]
        shared = len(tails)
    return shared / (n + m - shared)


def _named(docs: DataFrame) -> DataFrame:
    """doc (null doc_id: last) and h (hash of the text), which tell rows apart, and the text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("h"), "text")


def sketched(docs: DataFrame) -> DataFrame:
    """doc, h, c1, c2 (digest of the word sequence, or of the raw text where there are no words), sketch."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for a, b in textnum.slices(texts, textnum.WORK_BYTES):
                w = textnum.words(texts[a:b])
                raw = texts[a:b].to_pylist() if (w.counts == 0).any() else None
                c = np.zeros((2, b - a), np.uint64)
                found = []
                for i in range(b - a):
                    h = w.hash[w.first[i] : w.first[i + 1]]
                    if len(h):
                        place = np.arange(1, len(h) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        c[0, i], c[1, i] = textnum.mix(h + place).sum(), textnum.mix((h ^ np.uint64(0xA0761D6478BD642F)) + textnum.mix(place)).sum()
                        found.append(sketch(labelled_kmers(h)).view(np.int64) if len(h) > K else [])
                    else:
                        c[:, i] = [int.from_bytes(_digest(raw[i] or "")[j : j + 8], "little") for j in (0, 8)]
                        found.append([])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(c[0].view(np.int64)), pa.array(c[1].view(np.int64)), pa.array(found, pa.list_(pa.int64()))], ["doc", "h", "c1", "c2", "sketch"])

    return _named(docs).mapInArrow(run, "doc long, h long, c1 long, c2 long, sketch array<long>")


def _digest(text: str) -> bytes:
    from hashlib import blake2b

    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _kmer_table(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """id, kmers of the texts (id, doc, h) (checkpointed)."""

    def run(batches):
        for batch in batches:
            for a, b in textnum.slices(batch.column(1), textnum.WORK_BYTES):
                w = textnum.words(batch.column(1)[a:b])
                lists = [labelled_kmers(w.hash[w.first[i] : w.first[i + 1]]).view(np.int64) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(lists, pa.list_(pa.int64()))], ["id", "kmers"])

    n = texts.count()  # few are sent to all tasks, else the texts meet them in a shuffle
    rows = _named(docs).join(F.broadcast(texts) if n <= BROADCAST_IDS else texts, ["doc", "h"]).select("id", "text")
    found = rows.mapInArrow(run, "id long, kmers array<long>").checkpoint()
    return found if found.count() == n else found.dropDuplicates(["id"]).checkpoint()  # repeated rows


def _verify(pairs: DataFrame, kmers: DataFrame, wanted: float) -> DataFrame:
    """(lead, id) of the pairs (lead, id) that are alike."""

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(column.flatten()).view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])

    def run(batches):
        for batch in batches:
            (x, xs), (y, ys) = flat(batch.column(2)), flat(batch.column(3))
            alike = [aligned_similarity(x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]], wanted) >= wanted for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([column.filter(pa.array(alike, pa.bool_())) for column in batch.columns[:2]], ["lead", "id"])

    # the lists of one side go to those of the other; few pairs are sent to where the lists are first
    few = pairs.count() <= BROADCAST_IDS
    sent = F.broadcast(pairs) if few else pairs
    leads = kmers.select(F.col("id").alias("lead"), "kmers").join(F.broadcast(pairs.select("lead").distinct()) if few else pairs.select("lead").distinct(), "lead", "left_semi")
    joined = kmers.withColumnRenamed("kmers", "other").join(sent, "id").join(leads, "lead")
    return joined.select("lead", "id", "kmers", "other").mapInArrow(run, "lead long, id long")


def _lead_pairs(keyed: DataFrame) -> DataFrame:
    """lead, id, near (groups they share) of the groups of two or more, from (id, keys). The lead is the member in most company.

    Company is the sum of the sizes of all groups an id is in: the text that
    most others are near to, so most members are near to it.
    """
    rows = keyed.select("id", F.explode("keys").alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = rows.join(groups, "key")
    company = members.groupBy("id").agg(F.sum("n").alias("company"))
    leads = members.join(company, "id").groupBy("key").agg(F.max(F.struct("company", (-F.col("id")).alias("minus"))).alias("top"))
    led = members.join(leads.select("key", (-F.col("top.minus")).alias("lead")), "key")
    return led.filter("id <> lead").groupBy("lead", "id").agg(F.count("*").alias("near"))


def _settle(pairs: DataFrame, kmers: DataFrame, links: DataFrame, labels: DataFrame, wanted: float, by: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """links and labels after the pairs (lead, id, near) that are in different classes are verified, nearest first, until none is left.

    `limit` pairs for each value of `by` are verified first, BATCH times as many in each later round.
    """
    while True:
        of = lambda name: labels.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"))
        few = labels.count() <= BROADCAST_IDS
        sent = F.broadcast if few else (lambda df: df)
        apart = pairs.join(sent(of("id")), "id", "left").join(sent(of("lead")), "lead", "left")
        apart = apart.withColumn("id_label", F.coalesce("id_label", "id")).withColumn("lead_label", F.coalesce("lead_label", "lead")).filter("id_label <> lead_label")
        ranked = Window.partitionBy(*by).orderBy(F.desc("near"), "lead")
        apart = apart.withColumn("r", F.row_number().over(ranked)).select("lead", "id", "near", "r")
        apart = written(apart)
        if apart.isEmpty():
            return links, labels
        more = _verify(apart.filter(F.col("r") <= limit).select("lead", "id"), kmers, wanted)
        more = written(more)
        if not more.isEmpty():
            links = written(links.unionByName(more))
            labels = written(components(links))
        pairs, limit = apart.filter(F.col("r") > limit).select("lead", "id", "near"), limit * BATCH


def _links(docs: DataFrame, contents: DataFrame, wanted: float) -> tuple[DataFrame, DataFrame]:
    """(lead, id) of verified links between the contents (id, doc, h, sketch), and (id, label) of their components."""
    spark = docs.sparkSession
    led = _lead_pairs(contents.select("id", band_keys(F.col("sketch"), ROWS, BANDS).alias("keys"))).checkpoint()
    ids = led.select("id").unionByName(led.select(F.col("lead").alias("id"))).distinct()
    kmers = _kmer_table(docs, contents.select("id", "doc", "h").join(ids, "id").checkpoint())
    links, labels = spark.createDataFrame([], "lead long, id long"), spark.createDataFrame([], "id long, label long")
    links, labels = _settle(led, kmers, links, labels, wanted, ["id"], 1)
    # what can be alike and is in different classes yet
    return _settle(written(_candidates(kmers, labels, wanted)), kmers, links, labels, wanted, ["id", "lead_label"], BATCH)


def _common(kmers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common k-mers, COMMON_KMERS at most, and in how many of the counted texts they are.

    They only set the order of the prefix filter, which is exact in any order, so
    a sample of the texts does.
    """

    def count(batches):
        for batch in batches:
            k, n = np.unique(np.asarray(batch.column(0).flatten()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["kmer", "n"])

    found = kmers.filter(F.pmod("id", F.lit(COUNTED)) == 0).select("kmers").mapInArrow(count, "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n")).filter(F.col("n") > COMMON).checkpoint()
    least = COMMON
    while (kept := found.filter(F.col("n") > least)).count() > COMMON_KMERS:
        least *= 2
    table = kept.toArrow()
    names, n = table["kmer"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(names)
    return names[order], n[order]


def prefix(kmers: np.ndarray, common: tuple[np.ndarray, np.ndarray], wanted: float) -> np.ndarray:
    """The first k-mers of a text in the order common to all, so many that texts of the wanted similarity share one."""
    names, counts = common
    weight = np.zeros(len(kmers), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, kmers), len(names) - 1)
        weight = np.where(names[at] == kmers, counts[at], 0)
    return kmers[np.lexsort((kmers, weight))[: len(kmers) - math.ceil(wanted * len(kmers) - 1e-9) + 1]]


def _candidates(kmers: DataFrame, labels: DataFrame, wanted: float) -> DataFrame:
    """lead, id, near (prefix k-mers they share), each pair once: texts in different classes that can be alike, by prefix, size and place."""
    common = _common(kmers)

    def run(batches):
        for batch in batches:
            lists, ids = batch.column(1), batch.column(0).to_numpy()
            sizes = lists.value_lengths().to_numpy()
            x, first = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(sizes)])
            found = [prefix(x[first[i] : first[i + 1]], common, wanted) for i in range(batch.num_rows)]
            took = np.array([len(f) for f in found], np.int64)
            place = np.arange(took.sum()) - np.repeat(np.cumsum(took) - took, took)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, took)), pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(np.repeat(sizes, took).astype(np.int32)), pa.array(place.astype(np.int32))], ["id", "key", "n", "place"])

    of = labels.select("id", "label")
    few = labels.count() <= BROADCAST_IDS
    rows = kmers.mapInArrow(run, "id long, key long, n int, place int").join(F.broadcast(of) if few else of, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    rows = rows.join(mixed, "key", "left_semi").checkpoint()
    # members of a key's largest class are only compared with members of its others
    largest = rows.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    rows = rows.join(largest, "key")
    one = rows.filter("label <> largest").select("key", F.col("id").alias("a"), F.col("label").alias("a_label"), F.col("n").alias("a_n"), F.col("place").alias("a_place"))
    enough = F.least(F.col("a_n") - F.col("a_place"), F.col("n") - F.col("place")) >= wanted / (1 + wanted) * (F.col("a_n") + F.col("n")) - 1e-6
    near = one.join(rows, "key").filter((F.col("label") != F.col("a_label")) & ((F.col("label") == F.col("largest")) | (F.col("a") < F.col("id"))) & enough)
    return near.select(F.least("a", "id").alias("lead"), F.greatest("a", "id").alias("id")).groupBy("lead", "id").agg(F.count("*").alias("near"))


def components(links: DataFrame) -> DataFrame:
    """id, label (smallest id of its component) of every id that has a link.

    While the links are few (counted first) the labels are sent to all tasks and
    kept in few partitions; else they meet in shuffles.
    """
    n = links.count()
    few = n <= BROADCAST_IDS
    parts = n // LINKS_PER_PARTITION + 1
    sent = F.broadcast if few else (lambda df: df)
    kept = (lambda df: df.coalesce(parts).checkpoint()) if few else (lambda df: df.checkpoint())
    edges = links.select(F.col("lead").alias("a"), F.col("id").alias("b"))
    edges = kept(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(sent(labels.select(F.col("id").alias("b"), "label")), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hooked = near.join(sent(labels), "id").select("id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("further"))
        moved = kept(hooked.join(sent(jump), "low", "left").select("id", F.least("low", "further").alias("next"), "label"))
        labels = moved.select("id", F.col("next").alias("label"))
        if moved.filter("next < label").isEmpty():
            return labels


def _classified(docs: DataFrame, wanted: float) -> DataFrame:
    """doc, h of every row, copy (first row of equal words) and keeper (first row of the class) as structs (doc, h), and n_links."""
    ensure_checkpoint_dir(docs.sparkSession)
    sketches = sketched(docs).checkpoint()
    row = F.struct("doc", "h")
    contents = sketches.groupBy("c1", "c2").agg(F.min(row).alias("copy"), F.first("sketch").alias("sketch"), F.count("*").alias("n")).checkpoint()
    links, labels = _links(docs, contents.filter(F.size("sketch") > 0).select(F.col("c1").alias("id"), "copy.doc", "copy.h", "sketch"), wanted)
    counted = links.select("id").unionByName(links.select(F.col("lead").alias("id"))).groupBy("id").count()
    linked = contents.select("c1", "c2", "copy").join(labels.join(counted, "id").withColumnRenamed("id", "c1"), "c1").checkpoint()
    keepers = linked.groupBy("label").agg(F.min("copy").alias("keeper"))
    of_linked = linked.join(keepers, "label").select("c1", "c2", "keeper", "count")
    known = contents.filter("n > 1").select("c1", "c2", "copy").join(of_linked, ["c1", "c2"], "full_outer")
    found = sketches.select("doc", "h", "c1", "c2").join(known, ["c1", "c2"], "left").withColumn("copy", F.coalesce("copy", row))
    return found.select("doc", "h", "copy", F.coalesce("keeper", "copy").alias("keeper"), F.coalesce("count", F.lit(0)).cast("long").alias("n_links"))


def classes(docs: DataFrame, wanted: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), copy_of (smallest doc_id of equal words), n_links (verified links to different texts; not all that are alike are compared once they share a class)."""
    name = lambda c: F.nullif(F.col(c), F.lit(_LAST))
    return _classified(docs, wanted).select(name("doc").alias("doc_id"), name("keeper.doc").alias("class_id"), name("copy.doc").alias("copy_of"), "n_links")


def keep_one(docs: DataFrame, wanted: float = SIMILARITY) -> DataFrame:
    """One row of each class, all columns: the one that keeps the class; of equal such rows one."""
    row = F.struct("doc", "h")
    drop = _classified(docs, wanted).filter(row != F.col("keeper")).select("doc", "h").distinct().checkpoint()
    packed = pack(docs, doc=F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), h=F.xxhash64("text"))
    kept = packed.join(F.broadcast(drop) if drop.count() <= BROADCAST_IDS else drop, ["doc", "h"], "left_anti")
    rows = kept.select("doc", "h")
    if not rows.groupBy("doc", "h").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc", "h"])
    return unpack(kept)
