"""Operator 10: mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of `BLOCK` documents; a slot takes one
block. For a source of weight w its i-th block (from 1) is released at slot
floor((i - 1) / w) and due at slot ceil(i / w). Earliest deadline first among the
released blocks fills the slots; with weights that sum to 1 this meets every
deadline, so after any number of slots t a source has had w * t blocks with a
deviation of less than one.

Weights are exact rationals (`Fraction` of the given numbers), and all blocks of
all sources are scheduled, so the deviation does not grow with the table. The
schedule depends on all before, so the driver goes through it once (about 1 s a
million blocks, 16 million documents), but keeps only its state at every
`STRETCH`th slot (or every 64 slots a source, if that is more): three numbers a
source and stretch, under one byte a block. Tasks go on from there, a stretch
each, and make the slots. These are sent to all tasks up to `SENT_BLOCKS`; more
meet the documents in a shuffle. Documents are numbered within their source without bringing a source
together: a source is split by hash into groups of about `GROUP` documents,
groups are counted, and running sums of the counts give each group its first
number. A hot source has more groups, not larger ones.

No document is dropped or repeated. The target holds until the first source
runs out (`in_target`); after that the others go on in the same relative shares,
scheduled anew from there.
Default weights: the square root of a source's size.

Cases: null is a source of its own. Sources without a weight get weight 0 if
weights are given, and follow after all others. An empty table gives no rows.
Repeated rows each have a place; ties are ordered by doc_id, then by row
content. Input columns named as an added column are replaced.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 16
PERIOD = 1000
GROUP = 2000
#: Slots between two states of the schedule that the driver keeps.
STRETCH = 100_000
SENT_BLOCKS = 4_000_000
#: A block's key is its source's number above these bits, its own below.
NUMBER_BITS = 40
ADDED = ("mix_slot", "mix_index", "in_target")


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole shares of a period that sum to it, at least one for each positive weight (largest remainder); mix() itself uses the exact weights."""
    positive = {k: float(v) for k, v in weights.items() if v > 0}
    if not positive:
        return {}
    period = max(period, 4 * len(positive))
    total = sum(positive.values())
    exact = {k: v / total * (period - len(positive)) for k, v in positive.items()}
    out = {k: 1 + math.floor(x) for k, x in exact.items()}
    rest = period - sum(out.values())
    for k in sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], k))[:rest]:
        out[k] += 1
    return out


def advance(whole: list[int], done: list[int], limit: list[int], steps: int) -> tuple[list[int], bool]:
    """The sources of the next slots, up to `steps`, by EDF over Pfair windows, and whether a source's turn came that has no block left.

    whole: weights as integers; done: blocks of each source so far (their sum is the
    slot; counted on); limit: blocks it has. So any state of the schedule can be
    gone on from by these numbers alone.
    """
    total, t = sum(whole), sum(done)
    waiting = [(done[k] * total // w, k) for k, w in enumerate(whole)]  # release of the next block, source
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []  # deadline of the next block, source
    order: list[int] = []
    while len(order) < steps:
        while waiting and waiting[0][0] <= t:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[k] + 1) * total // whole[k]), k))
        k = heapq.heappop(ready)[1]
        if done[k] == limit[k]:
            return order, True
        done[k] += 1
        order.append(k)
        t += 1
        heapq.heappush(waiting, (done[k] * total // whole[k], k))
    return order, False


@dataclass
class Stretch:
    """Slots from `start` + `at` on, `steps` of them, and all that `advance` needs to find who has them; had: blocks of each source before `start`."""

    start: int
    at: int
    steps: int
    active: list[int]
    had: list[int]
    done: list[int]


def stretches(whole: list[int], blocks: list[int], every: int) -> tuple[list[Stretch], int]:
    """The schedule of all blocks in stretches of at most `every` slots, and the slot at which the first source lacks a block. From there on the others go on, scheduled anew."""
    had, start, horizon, found = [0] * len(whole), 0, None, []
    active = [k for k, n in enumerate(blocks) if n]
    if len(active) < len(blocks):
        horizon = 0
    while active:
        done, own, ended = [0] * len(active), [had[k] for k in active], False
        while not ended:
            before = list(done)
            order, ended = advance([whole[k] for k in active], done, [blocks[k] - had[k] for k in active], every)
            if order:
                found.append(Stretch(start, sum(before), len(order), active, own, before))
        for k, n in zip(active, done, strict=True):
            had[k] += n
        start += sum(done)
        horizon = start if horizon is None else horizon
        active = [k for k in active if had[k] < blocks[k]]
    return found, horizon or 0


def whole_weights(weights: dict[str, float]) -> tuple[list[str], list[int]]:
    """Names in order, and their exact weights over one denominator."""
    exact = {k: Fraction(w) for k, w in sorted(weights.items())}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return list(exact), [int(w * scale) for w in exact.values()]


def mixture(weights: dict[str, float], blocks: dict[str, int]) -> tuple[dict[str, list[int]], int]:
    """Slots of each source's blocks, EDF over Pfair windows of the exact weights, and the slot at which the first source lacks a block."""
    names, whole = whole_weights(weights)
    found, horizon = stretches(whole, [blocks[k] for k in names], STRETCH)
    slots: dict[str, list[int]] = {k: [] for k in weights}
    for s in found:
        order, _ = advance([whole[k] for k in s.active], list(s.done), [2**62] * len(s.active), s.steps)
        for t, k in enumerate(order):
            slots[names[s.active[k]]].append(s.start + s.at + t)
    return slots, horizon


def slot_table(spark: SparkSession, names: list[str], whole: list[int], found: list[Stretch], number_of: dict[str, int]) -> DataFrame:
    """block_key, slot of all blocks: each stretch is gone through in a task."""
    table = pa.table({f: pa.array([getattr(s, f) for s in found], kind) for f, kind in (("start", pa.int64()), ("at", pa.int64()), ("steps", pa.int64()), *((f, pa.list_(pa.int64())) for f in ("active", "had", "done")))})
    numbers = [number_of[k] for k in names]

    def run(batches):
        for batch in batches:
            for s in batch.to_pylist():
                order, _ = advance([whole[k] for k in s["active"]], list(s["done"]), [2**62] * len(s["active"]), s["steps"])
                of = np.array(order, np.int64)
                keys = np.zeros(len(of), np.int64)
                for k, source in enumerate(s["active"]):
                    own = np.flatnonzero(of == k)
                    keys[own] = (numbers[source] << NUMBER_BITS) + s["had"][k] + s["done"][k] + np.arange(len(own))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(s["start"] + s["at"] + np.arange(len(of)))], ["block_key", "slot"])

    rows = spark.createDataFrame(table) if found else spark.createDataFrame([], "start long, at long, steps long, active array<long>, had array<long>, done array<long>")
    return rows.repartition(min(max(1, len(found)), 10_000)).mapInArrow(run, "block_key long, slot long")


def schedule(share: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period of whole shares."""
    return mixture(share, share)[0]


def _source(column):
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """docs with mix_slot, mix_index (order of the mixture, gaps after a source's last block) and in_target."""
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ADDED]
    row = F.struct(*(docs[f"`{c}`"] for c in columns))
    # beside the id the short columns, so that null or repeated ids spread over the groups; the text is not read for it
    short = [docs[f"`{c}`"] for c, kind in docs.dtypes if c in columns and c != "text" and "map<" not in kind and "variant" not in kind]
    keyed = docs.select(row.alias("row"), _source(F.col("source")).alias("src"), F.xxhash64(*short).alias("h"), F.col("doc_id").alias("id"))
    # one row a source: as many as the mixture has weights
    sizes = {r.src: r["count"] for r in keyed.groupBy("src").count().collect()}
    wanted = {k: math.sqrt(n) for k, n in sizes.items()} if weights is None else {("null" if k is None else f"={k}"): w for k, w in weights.items() if ("null" if k is None else f"={k}") in sizes}
    blocks = {k: -(-n // block) for k, n in sizes.items()}
    names, whole = whole_weights({k: w for k, w in wanted.items() if w > 0})
    every = max(STRETCH, 64 * len(names))
    found, horizon = stretches(whole, [blocks[k] for k in names], every)
    # sources without weight come after everything else, one after the other
    scheduled, weighted = sum(blocks[k] for k in names), set(names)
    at, plan = scheduled, []
    for number, (k, n) in enumerate(sorted(sizes.items())):
        plan.append((k, number, max(1, -(-n // GROUP)), 0 if k in weighted else at))
        at += 0 if k in weighted else blocks[k]
    table = F.broadcast(spark.createDataFrame(plan, "src string, number long, groups long, offset long"))
    slots = slot_table(spark, names, whole, found, {k: number for k, number, _, _ in plan})
    if scheduled <= SENT_BLOCKS:
        slots = F.broadcast(slots)
    placed = keyed.join(table, "src").withColumn("g", F.pmod("h", "groups"))
    counted = keyed.select("src", "h").join(table.select("src", "groups"), "src").groupBy("src", F.pmod("h", "groups").alias("g")).count()
    first = counted.select("src", "g", F.coalesce(F.sum("count").over(Window.partitionBy("src").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    within = Window.partitionBy("src", "g").orderBy("h", "id", F.xxhash64("row"))
    numbered = placed.join(first, ["src", "g"]).withColumn("n", F.row_number().over(within) - 1 + F.col("first"))
    b = F.floor(F.col("n") / block).cast("long")
    found = numbered.withColumn("b", b).withColumn("block_key", F.shiftleft("number", NUMBER_BITS) + F.col("b")).join(slots, "block_key", "left")
    slot = F.coalesce("slot", F.col("offset") + F.col("b"))
    return found.select(
        *(F.col("row")[c].alias(c) for c in columns),
        slot.alias("mix_slot"),
        (slot * block + F.col("n") % block).alias("mix_index"),
        (slot < horizon).alias("in_target"),
    )


def in_order(mixed: DataFrame, parts: int) -> DataFrame:
    """The mixture as ordered files: range-partitioned and sorted by mix_index."""
    return mixed.repartitionByRange(parts, "mix_index").sortWithinPartitions("mix_index")
