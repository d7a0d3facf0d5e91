"""Operator 2: language identification by cross-parsing entropy.

For each language a suffix automaton holds every substring of a sample of its
labelled text. A text is cross-parsed: from where it stands, the longest match
in the automaton is one phrase (an unknown byte is a phrase by itself), then
parsing goes on behind it, across word ends. Texts, learned and parsed ones
alike, are lower-cased words with one blank between.

Phrases are normalised as the cross-parsing estimate of entropy asks: a text of m
bytes with c phrases against n learned bytes has c * log2(n) / m bits a byte, so
that a language with more learned text gains nothing from it. The language of
the smallest entropy wins, the first by name of equals.

Many texts are parsed side by side with array operations, all languages at
once, each text as a whole. Those of over `PIECE` bytes wait for each other and
are parsed together at the end of a batch, as a step costs nearly the same for one
text as for many.

Sample: at most `SAMPLE_DOCS` training documents a language, whole, those of
smallest id hash, however often an id is repeated; of rows with equal id the
smallest text. Learned from text and
lang only; a prediction uses the text only. Texts are read in place; nothing is
shuffled but the counts of languages and the sample.

Cases: null, empty and letterless texts are `und` with score 0. With no labelled
training rows every text is `und`. One learned language gives score 0. Equal
texts get equal results. Score: 1 - entropy of the best / of the second best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import fold, held_out, per_slice

FOLDS, HELD_OUT = 4, 2
SAMPLE_DOCS = 24
PIECE = 4096
#: Transitions are a dense table up to this size, else a sorted list: the same steps, slower and smaller.
TABLE_BYTES = 200_000_000
NONE = "und"


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions {byte: state} of each state of the automaton of all substrings of text; state 0 is the root."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for byte in text:
        cur = len(step)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and byte not in step[p]:
            step[p][byte] = cur
            p = link[p]
        if p >= 0:
            q = step[p][byte]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(step)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(byte) == q:
                    step[p][byte] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


def stream(w: textnum.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts as words with one blank before each and one at the end, and where each text begins."""
    n = len(w.first) - 1
    at = np.cumsum(np.concatenate([[0], w.length + 1]))  # of each word's blank, before the texts' last blanks
    begin = at[w.first] + np.arange(n + 1)
    out = np.full(int(begin[-1]), 32, np.uint8)
    text = np.repeat(np.arange(n), w.counts)
    inside = np.repeat(w.start, w.length) + np.arange(int(w.length.sum())) - np.repeat(np.cumsum(w.length) - w.length, w.length)
    to = np.arange(len(inside)) + np.repeat(np.arange(len(w.length)) + 1 + text, w.length)
    out[to] = w.data[inside]
    return out, begin


class Parser:
    """The automata of all languages in one table: states are numbered through, 0 is no state."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        used = np.unique(np.frombuffer(b" " + b"".join(samples.values()), np.uint8))
        self.symbol = np.full(256, len(used), np.int64)  # the last symbol has no transitions
        self.symbol[used] = np.arange(len(used))
        self.width = len(used) + 1
        self.bits = np.log2([max(len(samples[k]), 2) for k in self.languages])
        roots, keys, targets, states = [], [], [], 1
        for k in self.languages:
            automaton = suffix_automaton(samples[k])
            roots.append(states)
            for state, to in enumerate(automaton):
                keys += [(states + state) * self.width + int(self.symbol[byte]) for byte in to]
                targets += [states + target for target in to.values()]
            states += len(automaton)
        self.roots = np.array(roots, np.int64)
        key, target = np.array(keys, np.int64), np.array(targets, np.int32)
        self.dense = states * self.width * 4 <= TABLE_BYTES
        if self.dense:
            self.table = np.zeros(states * self.width, np.int32)
            self.table[key] = target
        else:
            order = np.argsort(key)
            self.key, self.target = key[order], target[order]

    def step(self, key: np.ndarray) -> np.ndarray:
        """Target of each state * width + symbol; 0: none."""
        if self.dense:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.target[at], 0)

    def phrases(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """[language, piece]: phrases of each piece of data."""
        order = np.argsort(-length, kind="stable")
        start, size = start[order], length[order]
        symbol = self.symbol[data]
        root = np.broadcast_to(self.roots[:, None], (len(self.roots), len(start)))
        state, count = root.copy(), np.zeros(root.shape, np.int64)
        longer = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0))  # pieces longer than t
        for t, n in enumerate(longer.tolist()):
            s = symbol[start[:n] + t]
            now = state[:, :n]
            to = self.step(now * self.width + s)
            language, piece = np.nonzero(to == 0)
            if len(piece):
                first = self.roots[language]
                again = self.step(first * self.width + s[piece]).astype(np.int64)
                # a phrase ended before this byte; a byte that no phrase begins with is one by itself
                count[language, piece] += (now[language, piece] != first).astype(np.int64) + (again == 0)
                to[language, piece] = np.where(again == 0, first, again)
            state[:, :n] = to
        count += state != root
        out = np.zeros_like(count)
        out[:, order] = count
        return out

    def rates(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """[text, language]: bits a byte of each stretch of data; 0 for an empty one."""
        return self.phrases(data, begin, size).T * self.bits / np.maximum(size, 1)[:, None]

    def entropies(self, w: textnum.Words, wait: list[tuple[int, np.ndarray]] | None = None) -> np.ndarray:
        """[text, language]: bits a byte of each text; 0 without words. Long texts are put off to `wait` (their number and bytes) if it is given."""
        data, begin = stream(w)
        size = np.where(w.counts > 0, np.diff(begin), 0)
        now = np.flatnonzero((size <= PIECE) | (wait is None))
        out = np.zeros((len(size), len(self.languages)))
        out[now] = self.rates(data, begin[now], size[now])
        if wait is not None:
            wait += [(i, data[begin[i] : begin[i] + size[i]]) for i in np.flatnonzero(size > PIECE).tolist()]
        return out

    def predict(self, texts: pa.Array) -> pa.Array:
        low = pc.utf8_lower(texts)
        lettered, bits = np.zeros(len(texts), bool), np.zeros((len(texts), max(1, len(self.languages))))
        long: list[tuple[int, np.ndarray]] = []
        for a, b, w in per_slice(low) if self.languages else ():
            lettered[a:b] = self._lettered(low[a:b], w)
            wait: list[tuple[int, np.ndarray]] = []
            bits[a:b] = self.entropies(w, wait)
            long += [(a + i, data) for i, data in wait]
        if long:
            size = np.array([len(data) for _, data in long])
            bits[[i for i, _ in long]] = self.rates(np.concatenate([data for _, data in long]), np.cumsum(size) - size, size)
        best, ordered = bits.argmin(axis=1), np.sort(bits, axis=1)
        score = 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1e-300) if bits.shape[1] > 1 else np.zeros(len(texts))
        names = [self.languages[i] if ok else NONE for i, ok in zip(best, lettered, strict=True)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))], ["lang_pred", "score"])

    @staticmethod
    def _lettered(texts: pa.Array, w: textnum.Words) -> np.ndarray:
        """Whether a text has any letter of any script."""
        ascii_letters = np.concatenate([[0], np.cumsum(textnum.LETTER[w.data])])[w.offsets]
        has = np.diff(ascii_letters) > 0
        for i in np.flatnonzero(~has & (w.counts > 0)).tolist():
            has[i] = any(c.isalpha() for c in texts[i].as_py())
        return has


def samples(docs: DataFrame) -> dict[str, bytes]:
    """Lower-cased words of the training sample of each language, one blank apart."""
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    if not counts:
        return {}
    # a cut on the id hash leaves about four times the wanted ids of each language, however many ids it has and however often they are repeated
    span = 2**52
    cut = F.create_map(*(x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(span, int(4 * SAMPLE_DOCS * span / max(n, 1)) + 1)))))
    drawn = rows.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(span))).filter(F.col("h") < cut[F.col("lang")])
    found: dict[str, list[tuple]] = {}
    for r in drawn.groupBy("lang", "h", "doc_id").agg(F.min("text").alias("text")).collect():
        found.setdefault(r.lang, []).append((r.h, r.doc_id, r.text))
    joined = {}
    for lang, chosen in found.items():
        texts = dict.fromkeys(x for _, _, x in sorted(chosen)[:SAMPLE_DOCS])  # copies count once
        data, _ = stream(textnum.words(pc.utf8_lower(pa.array(list(texts)))))
        joined[lang] = b" " + b" ".join(data.tobytes().split()) + b" "
    return joined


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    parser = Parser(samples(docs))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        return parser.predict(texts)

    found = docs.select("doc_id", predicted("text").alias("p"))
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "p.lang_pred", "p.score")
