"""Operator 7: toxicity by maximum-scoring segments.

Tokens are the words of a text and their first 4, 5 and 6 bytes, so that a stem
counts with any ending. A token is counted at its distinct places: the word and
the words before and behind it; so a copied passage counts once, however many
documents repeat it. Its log-odds compare its rate among all distinct places of
toxic training documents with that among those of other training documents,
under an informative Dirichlet prior: the pooled rates, `PRIOR` times the places
of each side. Tokens whose z-score passes a two-sided test at `FAMILY` over all
tested tokens together (Bonferroni) score their log-odds, negative ones too;
positive ones must reach `LEAST_ODDS` besides, so that a large sample does not
admit common words that differ a little. Every word scores its most telling
token's log-odds (0 if it has none) less a drift of `DRIFT` at least, and of
twice the mean log-odds of clean words if that is more: the expected score of
clean text is negative at every sample size.

A linear scan (Ruzzo and Tompa) finds every maximal scoring segment of a text.
The drift ends a passage once `odds / DRIFT` words go by without a toxic token.
Segment scores follow an extreme-value law with parameters lambda (the root of
E[exp(lambda * score)] = 1 over clean training words) and K (from the number of
segments in clean training documents); E = K * n * exp(-lambda * S) is the
expected number of such segments in n clean words. A text's best E-value and
its number of significant segments are turned into a probability by logistic
calibration on the training sample.

Sample: at most `PER_CLASS` documents a label. Every text is scored whole and
in place; no shuffle.

Cases: null counts as empty. Texts without scoring tokens have no segment and
get the calibrated floor. Without labels of both kinds, or with labels but no
token that tells them apart, no segment is found and every score is 0. Equal
texts get equal scores; copies within the training sample count once. An id
whose labels contradict each other is not trained on.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import ensure_checkpoint_dir, held_out, owners, per_slice
from .learn import labelled_sample, logistic, sigmoid

FOLDS, HELD_OUT = 3, 1
CUT = 0.7
PER_CLASS = 4000
PREFIXES = (4, 5, 6)
PRIOR, FAMILY, LEAST_ODDS, DRIFT = 0.1, 0.01, 1.5, 0.2
#: A token needs so many distinct places of toxic documents, else its test is void.
LEAST_PLACES = 5
SIGNIFICANT = 0.01
#: -log E above which a segment is no stronger evidence for the calibration.
MOST = 15.0


def tokens(w: textnum.Words) -> list[np.ndarray]:
    """One array a kind of token, each with one entry a word (0: none)."""
    return [w.hash, *(w.prefix(k) for k in PREFIXES)]


@dataclass
class Model:
    token: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = DRIFT
    lam: float = 1.0
    k: float = 1.0
    beta: np.ndarray | None = None

    def odds_of(self, w: textnum.Words) -> np.ndarray:
        """Log-odds of the most telling token of each word; 0 where none is known."""
        best = np.zeros(len(w.hash))
        if len(self.token):
            for kind in tokens(w):
                at = np.minimum(np.searchsorted(self.token, kind), len(self.token) - 1)
                odds = np.where(self.token[at] == kind, self.odds[at], 0.0)
                best = np.where(np.abs(odds) > np.abs(best), odds, best)
        return best

    def word_scores(self, w: textnum.Words) -> np.ndarray:
        return self.odds_of(w) - self.drift

    def segments(self, texts: pa.Array) -> list[list[tuple[float, int, int]]]:
        """Per text all maximal segments as (score, first word, last word + 1)."""
        out: list[list[tuple[float, int, int]]] = []
        for _, _, w in per_slice(texts):
            scores = self.word_scores(w)
            total = np.concatenate([[0.0], np.cumsum(scores)])
            hot = np.flatnonzero(scores > 0)
            cut = np.searchsorted(hot, w.first)
            for i in range(len(w.first) - 1):
                at = hot[cut[i] : cut[i + 1]]
                out.append(maximal_segments((at - w.first[i]).tolist(), total[at].tolist(), total[at + 1].tolist()) if len(at) else [])
        return out

    def log_e(self, found: list[tuple[float, int, int]], words: int) -> list[float]:
        return [float(np.log(self.k) + np.log(words) - self.lam * s) for s, _, _ in found]

    def statistics(self, found: list[list[tuple[float, int, int]]], counts: np.ndarray) -> np.ndarray:
        """1, -log E of the best segment and log(1 + significant segments), a row for each text."""
        rows = np.zeros((len(found), 3))
        rows[:, 0] = 1
        for i, segments in enumerate(found):
            if segments:
                e = self.log_e(segments, counts[i])
                rows[i, 1:] = min(max(0.0, -min(e)), MOST), np.log1p(sum(x <= np.log(SIGNIFICANT) for x in e))
        return rows

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        if self.beta is None:
            return np.zeros(len(texts)), [""] * len(texts)
        counts, found = word_counts(texts), self.segments(texts)
        spans = []
        for n, segments in zip(counts, found, strict=True):
            e = self.log_e(segments, n) if segments else []
            spans.append(",".join(f"{a}-{b}" for x, (_, a, b) in zip(e, segments, strict=True) if x <= np.log(SIGNIFICANT)))
        return sigmoid(self.statistics(found, counts) @ self.beta), spans


def word_counts(texts: pa.Array) -> np.ndarray:
    parts = [w.counts for _, _, w in per_slice(texts)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def maximal_segments(at: list[int], before: list[float], after: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of a sequence, from its positive places `at` and the running totals before and after each.

    Ruzzo and Tompa's linear-time algorithm: a stack of candidate segments, each
    with the running total before and after it. Other places only lower the total.
    """
    stack: list[tuple[float, float, int, int]] = []  # total before, total after, first, end
    for a, low, high in zip(at, before, after, strict=True):
        item = (low, high, a, a + 1)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= item[0]:
                j -= 1
            if j < 0 or stack[j][1] >= item[1]:
                stack.append(item)
                break
            item = (stack[j][0], item[1], stack[j][2], item[3])
            del stack[j:]
    return [(after - before, first, last) for before, after, first, last in stack]


def _places(w: textnum.Words) -> np.ndarray:
    """A digest of each word with the words before and behind it in its text."""
    before, behind = np.roll(w.hash, 1), np.roll(w.hash, -1)
    before[w.first[:-1][w.counts > 0]] = 0
    behind[w.first[1:][w.counts > 0] - 1] = 0
    return textnum.mix(before + textnum.mix(behind + textnum.mix(w.hash)))


def _token_odds(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with significant log-odds; counted and tested by Spark, only the significant ones are collected."""

    def tokens_at(batches):
        for batch in batches:
            texts, label = batch.column(0), batch.column(1).to_numpy()
            for a, b, w in per_slice(texts):
                if not len(w.hash):
                    continue
                # a place that is in several texts of the slice goes once
                place, first = np.unique(np.rec.fromarrays([_places(w), label[a:b][owners(w)]]), return_index=True)
                of = label[a:b][owners(w)][first].astype(np.int32)
                kinds = [kind[first] for kind in tokens(w)]
                columns = [pa.array(x.view(np.int64)) for x in (place.f0, *kinds)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(of)], names=["place", *(f"t{i}" for i in range(len(kinds))), "label"])

    names = [f"t{i}" for i in range(1 + len(PREFIXES))]
    places = sample.select("text", "label").mapInArrow(tokens_at, "place long, " + ", ".join(f"{n} long" for n in names) + ", label int").dropDuplicates(["place", "label"])
    total = places.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")).first()
    exploded = places.select("label", F.explode(F.array(*names)).alias("token")).filter("token <> 0")
    counts = exploded.groupBy("token").agg(F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0"))
    scored = _scored(counts, max(total.n1, 1), max(total.n0, 1)).checkpoint()
    tested = max(scored.count(), 1)
    z = NormalDist().inv_cdf(1 - FAMILY / 2 / tested)
    telling = (F.col("z") >= z) & (F.col("odds") >= LEAST_ODDS) | (F.col("z") <= -z)
    rows = scored.filter(telling).select("token", "odds").collect()
    token = np.array([r.token for r in rows], np.int64).view(np.uint64)
    value = np.array([r.odds for r in rows])
    order = np.argsort(token)
    return token[order], value[order]


def _scored(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """token, odds, z of the tokens (token, c1, c0) with enough places; n1, n0: all places of each side."""
    pooled = (F.col("c1") + F.col("c0")) * PRIOR / (n1 + n0)
    a1, a0 = F.col("c1") + pooled * n1, F.col("c0") + pooled * n0
    odds = F.log(a1 / (n1 * (1 + PRIOR) - a1)) - F.log(a0 / (n0 * (1 + PRIOR) - a0))
    enough = (F.col("c1") >= LEAST_PLACES) | (F.col("c0") >= LEAST_PLACES)
    return counts.filter(enough).select("token", odds.alias("odds"), (odds / F.sqrt(1 / a1 + 1 / a0)).alias("z"))


def _lambda(values: np.ndarray, rates: np.ndarray) -> float:
    """Positive root of sum(rate * exp(lambda * value)) = 1; values have a negative mean."""
    low, high = 1e-6, 1.0
    f = lambda x: float((rates * np.exp(np.minimum(x * values, 700))).sum()) - 1
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    ensure_checkpoint_dir(docs.sparkSession)
    drawn, counts = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, per_class)
    if not counts.get(0) or not counts.get(1):
        return Model()
    # at most 2 * per_class texts, read five times below
    sample = drawn.select(F.coalesce("text", F.lit("")).alias("text"), "label").dropDuplicates(["text", "label"]).checkpoint()
    model = Model(*_token_odds(sample))
    if not (model.odds > 0).any():
        return Model()
    clean = sample.filter("label = 0").select("text")

    def clean_odds(batches):
        """Clean words by rounded log-odds."""
        for batch in batches:
            for _, _, w in per_slice(batch.column(0)):
                v, c = np.unique(np.round(model.odds_of(w), 2), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(c)], ["value", "n"])

    seen = {r.value: r.n for r in clean.mapInArrow(clean_odds, "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).collect()}
    smallest = float(model.odds[model.odds > 0].min())
    # one more telling word than seen, so that no rate is 0
    value, rate = np.array([*seen, smallest]), np.array([*seen.values(), 1], float)
    words = rate.sum()
    model.drift = max(DRIFT, 2 * float((value * rate).sum() / words))
    model.lam = _lambda(value - model.drift, rate / words)

    def clean_segments(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(map(len, model.segments(batch.column(0))))]})

    segments = clean.mapInArrow(clean_segments, "n long").agg(F.sum("n")).first()[0] or 0
    model.k = max(segments, 1) / (words * np.exp(-model.lam * max(smallest - model.drift, 0.0)))

    def stats(batches):
        for batch in batches:
            texts = batch.column(0)
            x = model.statistics(model.segments(texts), word_counts(texts))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), batch.column(1)], ["e", "n", "label"])

    rows = sample.select("text", "label").mapInArrow(stats, "e double, n double, label int").collect()
    x = np.array([[1.0, r.e, r.n] for r in rows])
    y = np.array([float(r.label) for r in rows])
    weight = np.where(y == 1, counts[1] / max((y == 1).sum(), 1), counts[0] / max((y == 0).sum(), 1))
    model.beta = logistic(x, y, weight / weight.mean(), ridge=0.1)
    return model


def score(text: Column, model: Model) -> Column:
    @F.arrow_udf("struct<score:double,segments:string>")
    def scored(texts: pa.Array) -> pa.Array:
        s, spans = model.scores(texts)
        return pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array(spans, pa.string())], ["score", "segments"])

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages (word ranges `first-end`)."""
    scored = docs.select("doc_id", score(F.col("text"), fit(docs, labels)).alias("s"))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "s.score", (F.col("s.score") >= CUT).cast("int").alias("predicted"), "s.segments")
