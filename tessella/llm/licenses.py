"""Operator 3: license scan as an exact set-similarity join.

Every line of a document is a text block, and so is every run of as many words
as the template has that crosses a line end (wrapped notices). A block matches a
template when it holds at least `THRESHOLD` of the template's distinct words. The
join is exact; for lines:

1. words are ordered by how often they occur in all documents (one counting
   pass over the whole table, summed per word);
2. prefix filter: a block that matches has one of the template's
   `m - need + 1` rarest words;
3. length filter: a block of fewer than `need` words cannot match;
4. positional filter: from where the first shared prefix word stands in both
   orders, the words that can still be shared must suffice;
5. what is left is counted exactly.

Runs start at a word of the template; those with `need` such words are counted.

The base phrases are templates of threshold 1 whose words must also stand
consecutively; their one-word prefix is their rarest word. They are sought in
the whole text, across lines.

The templates are a fixed list in the code, so what tasks get has a fixed size.
Documents are read in place and not shuffled.

Cases: null counts as empty. Texts without words have no labels, null first and
last word and score 0. Overlapping places all count. Rows are answered one by
one, so repeated rows give equal answers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import owners

THRESHOLD = 0.8
# The phrases and labels of the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices in common use, as words. Labels are ours.
TEMPLATES = {
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-terms": "you may not use this file except in compliance with the license",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "mit-notice": "released under the mit license",
    "mit-terms": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this work has been released into the public domain",
}

_TYPE = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,blocks:string>"


def _vocabulary(templates: dict[str, str]) -> np.ndarray:
    return np.unique(np.concatenate([textnum.word_hash(x) for x in [*BASE, *templates.values()]]))


def word_counts(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> dict[int, int]:
    """How often each word of the templates occurs in all documents."""
    vocabulary = _vocabulary(templates)

    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            texts = batch.column(0)
            for a, b in textnum.slices(texts):
                h = textnum.words(texts[a:b]).hash
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                total += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary)), pa.int64()), pa.array(total)], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(vocabulary[r.word]): r.n for r in rows}


class Scanner:
    def __init__(self, counts: dict[int, int], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD):
        vocabulary = _vocabulary(templates)
        order = sorted(vocabulary.tolist(), key=lambda t: (counts.get(t, 0), t))
        rank = {t: i for i, t in enumerate(order)}
        self.sorted_terms = vocabulary
        self.rank_of = np.array([rank[t] for t in vocabulary.tolist()], np.int64)
        self.templates = []
        for label, text in sorted(templates.items()):
            ranks = np.array(sorted({rank[t] for t in textnum.word_hash(text).tolist()}), np.int64)
            need = math.ceil(threshold * len(ranks) - 1e-9)
            self.templates.append((label, ranks, need, len(textnum.word_hash(text))))
        self.phrases = []
        for phrase, label in sorted(BASE.items()):
            ranks = np.array([rank[t] for t in textnum.word_hash(phrase).tolist()], np.int64)
            self.phrases.append((label, ranks, int(np.argmin(ranks))))

    def scan(self, texts: pa.Array) -> pa.Array:
        parts = [self._scan(textnum.words(texts[a:b])) for a, b in textnum.slices(texts)]
        return pa.concat_arrays(parts or [self._scan(textnum.words(texts))])

    def _places(self, w: textnum.Words, rank: np.ndarray, owner: np.ndarray, ranks: np.ndarray, rarest: int) -> np.ndarray:
        start = np.flatnonzero(rank == ranks[rarest]) - rarest
        start = start[(start >= 0) & (start + len(ranks) <= len(rank))]
        start = start[owner[start] == owner[start + len(ranks) - 1]]
        for i, r in enumerate(ranks):
            start = start[rank[start + i] == r]
        return start

    @staticmethod
    def _wrapped(rank: np.ndarray, owner: np.ndarray, block: np.ndarray, position: np.ndarray, need: int, width: int) -> list[tuple[int, int, int]]:
        """(first word, word after the last, distinct template words) of the runs of `width` words across line ends that hold `need`."""
        hit = np.flatnonzero((rank >= 0) & (position[rank] >= 0))
        if len(hit) < need:
            return []
        order = np.lexsort((hit, rank[hit]))
        before = np.full(len(hit), -1)  # where the same word stood last
        same = rank[hit[order[1:]]] == rank[hit[order[:-1]]]
        before[order[1:][same]] = hit[order[:-1][same]]
        first = np.flatnonzero(hit[need - 1 :] - hit[: len(hit) - need + 1] < width)
        begin = hit[first]
        found, last = np.zeros(len(first), np.int64), begin.copy()
        for step in range(width):
            j = np.minimum(first + step, len(hit) - 1)
            inside = (first + step < len(hit)) & (hit[j] < begin + width) & (owner[hit[j]] == owner[begin]) & (before[j] < begin)
            found += inside
            last = np.where(inside, hit[j], last)
        fits = (found >= need) & (block[begin] != block[last])
        return list(zip(begin[fits].tolist(), (last[fits] + 1).tolist(), found[fits].tolist(), strict=True))

    def _scan(self, w: textnum.Words) -> pa.Array:
        n = len(w.first) - 1
        owner = owners(w)
        at = np.minimum(np.searchsorted(self.sorted_terms, w.hash), len(self.sorted_terms) - 1)
        rank = np.where(self.sorted_terms[at] == w.hash, self.rank_of[at], -1)
        base_labels: list[set] = [set() for _ in range(n)]
        labels: list[set] = [set() for _ in range(n)]
        blocks: list[list] = [[] for _ in range(n)]
        score = np.zeros(n)
        n_base, first, last = np.zeros(n, np.int64), np.full(n, 2**62), np.full(n, -1)
        for label, ranks, rarest in self.phrases:
            start = self._places(w, rank, owner, ranks, rarest)
            text = owner[start]
            np.add.at(n_base, text, 1)
            np.minimum.at(first, text, start - w.first[text])
            np.maximum.at(last, text, start - w.first[text])
            score[text] = 1.0
            for i in np.unique(text).tolist():
                base_labels[i].add(label)
                labels[i].add(label)
        # blocks: lines, numbered through all texts of the slice
        lines = np.flatnonzero(w.data == 10)
        block = np.searchsorted(lines, w.start) + owner
        size = np.bincount(block) if len(block) else np.zeros(0, np.int64)
        known = rank >= 0
        v = len(self.sorted_terms)
        pairs = np.unique(block[known] * v + rank[known])
        of, term = pairs // v, pairs % v
        held = np.bincount(of, minlength=len(size))
        begin = np.cumsum(held) - held
        place = np.arange(len(pairs)) - begin[of]
        for label, ranks, need, width in self.templates:
            position = np.full(v, -1)
            position[ranks] = np.arange(len(ranks))
            for start, stop, found in self._wrapped(rank, owner, block, position, need, width):
                text = int(owner[start])
                share = float(found / len(ranks))
                labels[text].add(label)
                blocks[text].append(f"{label}@{start - int(w.first[text])}+{stop - start}={share:.3f}")
                score[text] = max(score[text], share)
            i = position[term]
            prefix = np.flatnonzero((i >= 0) & (i <= len(ranks) - need))
            _, once = np.unique(of[prefix], return_index=True)
            prefix = prefix[once]
            possible = 1 + np.minimum(len(ranks) - 1 - i[prefix], held[of[prefix]] - 1 - place[prefix])
            candidates = of[prefix][(size[of[prefix]] >= need) & (possible >= need)]
            if not len(candidates):
                continue
            wanted = np.zeros(len(size), bool)
            wanted[candidates] = True
            overlap = np.bincount(of[(i >= 0) & wanted[of]], minlength=len(size))
            for b in candidates[overlap[candidates] >= need].tolist():
                word = int(np.searchsorted(block, b))
                text = int(owner[word])
                share = float(overlap[b] / len(ranks))
                labels[text].add(label)
                blocks[text].append(f"{label}@{word - int(w.first[text])}+{int(size[b])}={share:.3f}")
                score[text] = max(score[text], share)
        none = n_base == 0
        texts = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
        return pa.StructArray.from_arrays(
            [pa.array(w.counts, pa.int64()), pa.array(n_base), pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none), texts(base_labels), texts(labels), pa.array(score), texts(blocks)],
            ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
        )


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the matching blocks.

    blocks: `label@first word+words=containment`, comma-joined.
    """
    scanner = Scanner(word_counts(docs, templates), templates, threshold)

    @F.arrow_udf(_TYPE)
    def scanned(texts: pa.Array) -> pa.Array:
        return scanner.scan(texts)

    return docs.select("doc_id", scanned("text").alias("s")).select("doc_id", "s.*")
