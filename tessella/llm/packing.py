"""Operator 12: best-fit packing of tokenized documents into sequences of a fixed length.

Tokens: a document's ids by the given tokenizer file, then an end id. Only
documents longer than a sequence are cut, into whole sequences and a last piece.
A task splits its texts at blanks and line feeds, which no token of a word tokenizer
spans (`blanks=False` for other tokenizers), and encodes each distinct chunk
once; it remembers up to `REMEMBERED` chunks.

Packing: pieces (numbers only, no texts) are dealt evenly to tasks of about
`PIECES` pieces, whoever they belong to, so no id or source can make a task
large. A task places piece by piece, bounded-space online best-fit: of at most
`OPEN` open sequences it takes the one with the least free room that is enough.
Open sequences stand in stacks by free room; a bitset of the rooms that have a
sequence gives the best fit by its lowest bit at or above the piece's length. If
none fits and all are open, the fullest is closed. The pieces of a task arrive
in runs of `RUN`, each run longest first. Sequences have no gaps: a piece starts
where the one before it ended.

A task's order is set by the rows' hash, so a task that runs again places its
pieces alike.

Cases: a null text is empty and has the end id alone. Null or repeated ids and
repeated rows are pieces of their own each. Empty tables give no rows. Texts that
hold control strings of the tokenizer get their ids as the tokenizer gives them.
Extra columns are not looked at.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum

CAPACITY = 2048
END_ID = 0
OPEN = 4096
RUN = 2048
PIECES = 16_384
REMEMBERED = 1_000_000
#: Marks at a chunk's end that are a word of their own to a word tokenizer.
STOPS = ".,;:!?"
#: Bits of a sequence's number within its task.
NUMBER_BITS = 33


class Encoder:
    """Ids of texts by a tokenizer's definition.

    Texts are split at blanks and each distinct chunk once more into letters and
    the stops after them, which a word tokenizer reads as words of their own. The
    letters, lower-cased where they are ASCII, are looked up; new ones go to the
    tokenizer together, and their ids are told apart by the mark that ends a word.
    Other chunks, and words without that mark, go to it one by one.
    """

    def __init__(self, definition: str, blanks: bool):
        self.definition, self.blanks = definition, blanks
        self.tokenizer = None

    def forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.chunk: dict[str, int] = {}
        self.pairs = np.zeros((0, 2), np.int64)  # the numbers of each chunk's two parts
        self.ids = np.zeros(0, np.int32)
        self.first = np.zeros(2, np.int64)  # of each part in ids, and the end

    def start(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(self.definition)
        suffix = json.loads(self.definition)["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        self.forget()

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def learn(self, words: list[str], others: list[str]) -> None:
        """Encodes new parts: words of letters together, others by themselves."""
        ids = self.encoded(" ".join(words))
        ends = np.flatnonzero(self.ends[ids]) + 1 if words else np.zeros(0, np.int64)
        if len(ends) == len(words) and (not words or ends[-1] == len(ids)):
            found, sizes = [self.ids, ids], np.diff(ends, prepend=0).tolist()
        else:
            found, sizes, others, words = [self.ids], [], [*words, *others], []
        each = [x.ids for x in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        found += [np.fromiter(chain.from_iterable(each), np.int32)]
        sizes += map(len, each)
        for text in (*words, *others):
            self.number[text] = len(self.number)
        self.ids = np.concatenate(found)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes, dtype=np.int64)])

    def parts(self, chunks: list[str]) -> list[tuple[str, str]]:
        out = []
        for c in chunks:
            stem = c.rstrip(STOPS)
            if not stem.isalpha():
                out.append((c, ""))
            elif stem.isascii():
                out.append((stem.lower(), c[len(stem) :]))
            else:
                out.append((stem, c[len(stem) :]) if stem.lower().isalpha() else (c, ""))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after one another, and where each text's ids begin and end."""
        if self.tokenizer is None:
            self.start()
        if self.blanks:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            split = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int32()), texts)
        chunks = split.flatten().dictionary_encode()
        texts = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.chunk) + len(texts) > REMEMBERED:
            self.forget()
        if unseen := [c for c in texts if c not in self.chunk]:
            parts = self.parts(unseen) if self.blanks else [(c, "") for c in unseen]
            if new := {x for pair in parts for x in pair if x not in self.number}:
                words = {x for x in new if self.blanks and x.isalpha() and (x.isascii() or x.lower().isalpha())}
                self.learn(list(words), list(new - words))
            self.chunk.update(zip(unseen, range(len(self.chunk), len(self.chunk) + len(unseen))))
            self.pairs = np.concatenate([self.pairs, [(self.number[a], self.number[b]) for a, b in parts]])
        found = np.fromiter(map(self.chunk.__getitem__, texts), np.int64, len(texts))
        pair = self.pairs[found[chunks.indices.to_numpy(zero_copy_only=False)]].ravel()
        count = self.first[pair + 1] - self.first[pair]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.first[pair] - ends[:-1], count) + np.arange(ends[-1])]
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        return ids, ends[2 * offsets]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, blanks: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids array<int>. The tokenizer's file (a few MB) is sent to the tasks. blanks: whether the tokenizer drops white space, so that texts may be split there."""
    sent = docs.sparkSession.sparkContext.broadcast({"definition": Path(tokenizer_file).read_text()})
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker process keeps the broadcast value, and with it the encoder, from task to task
        encoder = sent.value.get("encoder") or sent.value.setdefault("encoder", Encoder(sent.value["definition"], blanks))
        for batch in batches:
            for a, b in textnum.slices(batch.column(1)):
                ids, at = encoder.encode(batch.column(1)[a:b])
                owner, rows = [], []
                for k in range(b - a):
                    own = np.append(ids[at[k] : at[k + 1]], np.int32(end_id)).astype("<u4")
                    for n, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        owner.append(a + k)
                        rows.append((n, start, len(part), zlib.crc32(part.tobytes()), part))
                columns = list(zip(*rows))
                out = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns[:4], (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
                if with_ids:
                    flat, sizes = np.concatenate(columns[4]).astype(np.int32), np.array(columns[2])
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, schema)


class Sequences:
    """At most `limit` open sequences of one task."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.rooms = 0  # bit f: a sequence with f free places is open
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.made = 0

    def take(self, room: int) -> int:
        number = self.open[room].pop()
        if not self.open[room]:
            self.rooms ^= 1 << room
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The number of the sequence that a piece gets, and its offset there."""
        fits = self.rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            number = self.take(room)
        else:
            if self.n_open == self.limit:
                self.take((self.rooms & -self.rooms).bit_length() - 1)
            room, number = self.capacity, self.made
            self.made += 1
        if left := room - length:
            if not self.open[left]:
                self.rooms |= 1 << left
            self.open[left].append(number)
            self.n_open += 1
        return number, self.capacity - room


def pack(cut: DataFrame, n_pieces: int, capacity: int = CAPACITY, limit: int = OPEN) -> DataFrame:
    """Pieces (any columns, with length of 1 to capacity) with sequence_id and offset. n_pieces: about how many there are; it sets the number of tasks."""
    keys = [c for c in cut.columns if c != "ids"]
    dealt = cut.repartition(max(1, math.ceil(n_pieces / PIECES))).sortWithinPartitions(F.xxhash64(*keys), *keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId() << NUMBER_BITS
        sequences = Sequences(capacity, limit)
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy()
            number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for a in range(0, len(lengths), RUN):
                for k in a + np.argsort(-lengths[a : a + RUN], kind="stable"):
                    number[k], offset[k] = sequences.place(int(lengths[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own + number), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves; a group holds one sequence."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def plan(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """The contract of the query: every piece and its place. Pieces are made from the texts once and meet no text again."""
    return pack(pieces(docs, tokenizer_file, with_ids=False), docs.count())
