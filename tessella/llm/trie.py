"""Operator 11: conversation prefix trie by family-first merging.

A family is the conversations of one base id (c - c % `FAMILY`). A conversation c is
rebuilt from the first h turns of its base and its own turns after its first h,
h = crc32(decimal c) % `BORROWED`. Turns travel as a digest of role and text and the
text's code points; texts stay where they are read.

1. Turns are numbered within their conversation and cogrouped by base id with
   the base's first turns. Each family's conversations are rebuilt and inserted
   into a trie in ascending order of their ids. It sends one row a node: counts
   and sums over the node's subtree within the family, and the ids that end
   there. A node's key is the digest of its parent's key and its turn, so equal
   prefixes of different families have equal keys.
2. Family nodes meet by key. Members and weighted sums (members x code points) add
   up. Sums over different nodes (leaves, children, code points once) count a
   node that k families share k times: each shared node corrects that, and its
   correction goes to all its ancestors, which are shared too. That takes
   log2(depth) joins of the shared nodes with themselves (every round doubles
   the distance).
3. Ids of conversations that end at a node are hashed as a stream in the order of
   families; families are ranges of ids, so that is the order of ids. (A digest of
   a list is made from its first id to its last, so one task hashes a node's ids,
   some bytes each, with the digest's state alone in memory.)

Bounds: a family has at most 2 x FAMILY - 1 ids of at most `LONG` turns each, so its
trie has a bounded size whatever the table's size. A conversation with more turns
is a family of its own, a chain, and goes through its task turn by turn with one
key as state. Its turns are numbered and chained one after the other, which its
keys ask for, in bounded memory.

Cases: null turns come first, turns of equal number in the order of role and
digest; null roles and texts are empty. Rows without conv_id belong to no
conversation and are left out. Repeated rows are turns of their own. % keeps the
sign of a negative id. An empty table has no conversations and no nodes. Extra
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, written

FAMILY = 100
BORROWED = 6
#: At least BORROWED, so that no long conversation is without turns of its own.
LONG = 1024
#: Distances doubled before the plan is cut with a table.
ROUNDS = 3
ROOT = (0, 0)
NODE = (
    "k1 long, k2 long, p1 long, p2 long, depth long, chars long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, weighted long, once long, is_leaf long, n_ends long, ends string"
)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def borrowed(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % BORROWED


def _borrowed(conv_id: Column) -> Column:
    return F.crc32(F.encode(conv_id.cast("string"), "UTF-8")) % BORROWED


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, chars, n_turns; role and text are gone."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256), 1, 32))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    own = Window.partitionBy("conv_id")
    return rows.select("conv_id", F.row_number().over(own.orderBy(F.asc_nulls_first("turn"), "role", "digest")).cast("long").alias("pos"), "digest", "chars", F.count(F.lit(1)).over(own).alias("n_turns"))


def next_key(key: tuple[int, int], digest: bytes) -> tuple[int, int]:
    """Two signed 64-bit halves of the digest of a parent's key and a turn's digest."""
    whole = hashlib.sha256(key[0].to_bytes(8, "big", signed=True) + key[1].to_bytes(8, "big", signed=True) + digest).digest()
    return int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:16], "big", signed=True)


class Family:
    """The trie of one family; conversations are inserted in ascending order of id."""

    def __init__(self) -> None:
        self.key, self.parent, self.depth, self.chars = [ROOT], [0], [0], [0]
        self.first: list[int] = []
        self.n_convs, self.ends = [0], [[]]
        self.below: dict[tuple[int, bytes], int] = {}

    def insert(self, conv_id: int, turns: list[tuple[bytes, int]]) -> None:
        at = 0
        if not self.first:
            self.first.append(conv_id)
        self.n_convs[0] += 1
        for digest, chars in turns:
            child = self.below.get((at, digest))
            if child is None:
                child = self.below[at, digest] = len(self.key)
                self.key.append(next_key(self.key[at], digest))
                self.parent.append(at)
                self.depth.append(self.depth[at] + 1)
                self.chars.append(chars)
                self.first.append(conv_id)
                self.n_convs.append(0)
                self.ends.append([])
            at = child
            self.n_convs[at] += 1
        self.ends[at].append(conv_id)

    def rows(self) -> list[tuple]:
        n = len(self.key)
        children, leaves = [0] * n, [0] * n
        weighted, once = [m * c for m, c in zip(self.n_convs, self.chars)], list(self.chars)
        out = []
        for k in range(n - 1, -1, -1):  # children come after their parent
            leaf = not children[k]
            leaves[k] += leaf
            up = self.parent[k]
            if k:
                children[up] += 1
                leaves[up] += leaves[k]
                weighted[up] += weighted[k]
                once[up] += once[k]
            p = self.key[up] if k else (None, None)
            ends = ",".join(map(str, self.ends[k])) if self.ends[k] else None
            out.append((*self.key[k], *p, self.depth[k], self.chars[k], self.first[k], self.first[up] if k else None, self.n_convs[k], children[k], leaves[k], weighted[k], once[k], int(leaf), len(self.ends[k]), ends))
        return out


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


SCHEMA = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in NODE.split(", ")])


def family_nodes(members: DataFrame, bases: DataFrame) -> DataFrame:
    """Rows of numbered conversations, and those of base conversations, as the nodes of each family's trie."""

    def build(members: pa.Table, base: pa.Table) -> pa.Table:
        family = Family()
        if members.num_rows:
            shared = [(d, c) for _, d, c in sorted(zip(*(base[x].to_pylist() for x in ("pos", "digest", "chars"))))]
            rows = sorted(zip(*(members[x].to_pylist() for x in ("conv_id", "pos", "digest", "chars"))))
            begin = 0
            for k in range(1, len(rows) + 1):
                if k == len(rows) or rows[k][0] != rows[begin][0]:
                    conv_id = rows[begin][0]
                    h = borrowed(conv_id)
                    family.insert(conv_id, shared[:h] + [(d, c) for _, _, d, c in rows[begin + h : k]])
                    begin = k
        return _table(family.rows() if members.num_rows else [], SCHEMA)

    keyed = lambda rows: rows.withColumn("base", base_of(F.col("conv_id"))).groupBy("base")
    return keyed(members).cogroup(keyed(bases)).applyInArrow(build, NODE)


def chain_nodes(members: DataFrame, bases: DataFrame) -> DataFrame:
    """The same rows for conversations of any length, each a trie of its own that goes by as a stream."""
    ids = members.select("conv_id").distinct().withColumn("h", _borrowed(F.col("conv_id")))
    from_base = ids.withColumn("base", base_of(F.col("conv_id"))).join(bases.select(F.col("conv_id").alias("base"), "pos", "digest", "chars"), "base").filter("pos <= h").select("conv_id", F.lit(0).alias("own"), "pos", "digest", "chars")
    own = members.filter(F.col("pos") > _borrowed(F.col("conv_id"))).select("conv_id", F.lit(1).alias("own"), "pos", "digest", "chars")
    turns = own.unionByName(from_base)
    total = turns.groupBy("conv_id").agg(F.sum("chars").alias("total"), F.count(F.lit(1)).alias("n"))
    streams = turns.join(total, "conv_id").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "own", "pos").select("conv_id", "digest", "chars", "total", "n")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, key, depth, passed = None, ROOT, 0, 0
        for batch in batches:
            out = []
            for conv_id, digest, chars, total, n in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != current:
                    current, key, depth, passed = conv_id, ROOT, 0, 0
                    out.append((*ROOT, None, None, 0, 0, conv_id, None, 1, 1, 1, total, total, 0, 0, None))
                above, key, depth = key, next_key(key, digest), depth + 1
                rest, leaf = total - passed, int(depth == n)
                out.append((*key, *above, depth, chars, conv_id, conv_id, 1, 1 - leaf, 1, rest, rest, leaf, leaf, str(conv_id) if leaf else None))
                passed += chars
            yield from _table(out, SCHEMA).to_batches()

    return streams.mapInArrow(chain, NODE)


def _with_descendants(shared: DataFrame, deepest: int) -> DataFrame:
    """shared (k1, k2, p1, p2, once, leaves) with its sums over each node's whole subtree, by doubling distances."""
    sums = shared.select("k1", "k2", F.col("p1").alias("j1"), F.col("p2").alias("j2"), "once", "leaves")
    for step in range(math.ceil(math.log2(deepest + 1)) if deepest else 0):
        if step and step % ROUNDS == 0:
            sums = written(sums)
        up = sums.filter("j1 is not null").groupBy(F.col("j1").alias("k1"), F.col("j2").alias("k2")).agg(F.sum("once").alias("once_up"), F.sum("leaves").alias("leaves_up"))
        jumps = sums.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("j1").alias("n1"), F.col("j2").alias("n2"))
        sums = (
            sums.join(up, ["k1", "k2"], "left")
            .join(jumps, ["j1", "j2"], "left")
            .select("k1", "k2", F.col("n1").alias("j1"), F.col("n2").alias("j2"), (F.col("once") + F.coalesce("once_up", F.lit(0))).alias("once"), (F.col("leaves") + F.coalesce("leaves_up", F.lit(0))).alias("leaves"))
        )
    return sums.select("k1", "k2", "once", "leaves")


def hashed_ends(nodes: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the nodes where conversations end: ids in ascending order, hashed as they go by. A family's ids, in one row or more, are put in order together."""
    rows = nodes.filter("n_ends > 0").select("k1", "k2", base_of(F.substring_index("ends", ",", 1).cast("long")).alias("base"), "ends")
    streams = rows.repartition(F.col("k1"), F.col("k2")).sortWithinPartitions("k1", "k2", "base")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids, state, done = None, [], None, []  # of: key and base of the ids at hand

        def take(following: tuple | None) -> None:
            """Hashes the ids at hand; ends their node if another one follows."""
            nonlocal state
            text = ",".join(map(str, sorted(ids))).encode()
            ids.clear()
            if state is None:
                state = hashlib.sha256(text)
            else:
                state.update(b"," + text)
            if following is None or following[:2] != of[:2]:
                done.append((*of[:2], state.hexdigest()))
                state = None

        def batch_of_done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else ((), (), ()), (pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])
            done.clear()
            return out

        for batch in batches:
            for *at, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if of is not None and of != at:
                    take(at)
                of = at
                ids.extend(map(int, ends.split(",")))
            yield batch_of_done()
        if of is not None:
            take(None)
            yield batch_of_done()

    return streams.mapInArrow(hashes, "k1 long, k2 long, ends_sha256 string")


def build(conversations: DataFrame) -> DataFrame:
    """All nodes: key and parent_key (32 hex digits), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = written(numbered(conversations))  # some 40 bytes a turn; texts are read once
    bases = rows.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < BORROWED)).select("conv_id", "pos", "digest", "chars")
    families = family_nodes(rows.filter(F.col("n_turns") <= LONG), bases)
    found = written(families.unionByName(chain_nodes(rows.filter(F.col("n_turns") > LONG), bases)))
    summed = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weighted", "once", "is_leaf", "n_ends")}
    least = {c: F.min(c).alias(c) for c in ("p1", "p2", "depth", "chars", "conv_id", "parent_conv_id")}
    nodes = written(found.drop("ends").groupBy("k1", "k2").agg(*summed.values(), *least.values(), F.count(F.lit(1)).alias("k")))
    # what shared nodes have counted too often
    again = F.col("k") - 1
    shared = nodes.filter("k > 1").select("k1", "k2", "p1", "p2", "depth", "conv_id", again.alias("again"), (again * F.col("chars")).alias("once"), F.when(F.col("n_children") == 0, again).otherwise(F.col("is_leaf")).alias("leaves"))
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    too_many = _with_descendants(shared, deepest).select("k1", "k2", F.col("once").alias("x_once"), F.col("leaves").alias("x_leaves"))
    children = shared.filter("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("again").alias("x_children"))
    too_many = written(too_many.join(children, ["k1", "k2"], "left").join(shared.select("k1", "k2", F.col("conv_id").alias("least")), ["k1", "k2"]))
    parents = too_many.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("least_parent"))
    whole = nodes.join(too_many.drop("least"), ["k1", "k2"], "left").join(hashed_ends(found), ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left")
    key = lambda a, b: F.when(F.col(a).isNotNull(), F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))
    less = lambda c: F.coalesce(f"x_{c}", F.lit(0))
    return whole.select(
        key("k1", "k2").alias("key"),
        key("p1", "p2").alias("parent_key"),
        "conv_id",
        "depth",
        F.coalesce("least_parent", "parent_conv_id").alias("parent_conv_id"),
        "n_convs",
        (F.col("n_children") - less("children")).alias("n_children"),
        (F.col("n_leaves") - less("leaves")).alias("n_leaves"),
        (F.col("weighted") - F.col("once") + less("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), role, text: the turns of the rebuilt conversations, whole. Joined with nodes on conv_id and depth they give each node's role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256), 1, 32)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), digest.alias("digest")).withColumn("pos", F.row_number().over(order).cast("long"))
    ids = rows.select("conv_id").distinct().select("conv_id", base_of(F.col("conv_id")).alias("base"), _borrowed(F.col("conv_id")).alias("h"))
    first = rows.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < BORROWED)).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    head = ids.join(first, "base").filter("pos <= h").select("conv_id", F.lit(0).alias("own"), "pos", "role", "text")
    tail = rows.filter(F.col("pos") > _borrowed(F.col("conv_id"))).select("conv_id", F.lit(1).alias("own"), "pos", "role", "text")
    return head.unionByName(tail).select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("own", "pos")).cast("long").alias("depth"), "role", "text")


def report(conversations: DataFrame) -> DataFrame:
    """The contract of the query: a row for each node."""
    return build(conversations).drop("key", "parent_key")
