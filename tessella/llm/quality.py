"""Operator 4: quality classifier by Bradley-Terry pairwise ranking.

Each document has features of its whole text (repetition of words and word
pairs, letter case, symbols, line shape). Every training document of label 1 is
preferred to every one of label 0; ridge logistic loss over all these pairs
yields a linear score, so that sigmoid(s(a) - s(b)) is the chance that a is
preferred. The threshold is a quantile of the scores of all training documents:
the share of label 0 among them.

Training: features of all training documents are computed once, in place, and
stored until the model is fitted; there is no sample of documents or pairs. A
step of Newton's method is one pass over them. As a pair's chance depends on two
scores alone, a pass sums documents, features and products of features by label
at nodes `STEP` apart on the axis of scores (each document is shared out to four
nodes by cubic interpolation, which gives sigmoid to 1e-6), and the driver adds
up all pairs of nodes. The coefficients are rounded to 9 decimals, as the sums
of tasks arrive in any order.

Every document is scored from its own text alone, in place, without a shuffle.

Cases: null counts as empty; empty and wordless texts have features of zero
and get a score as any other. Without labels of both kinds every score is 0.5.
Repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import held_out, n_stored, owners, pack, per_slice, release, unpack, written
from .learn import at_rank, labelled_features, sigmoid

FOLDS, HELD_OUT = 5, 0
CUT = 0.3
#: Weight of the squared coefficients beside the mean loss of a pair; distance of nodes on the axis of scores.
RIDGE, STEP = 1 / 800, 1 / 8
ROUNDS = 30
FEATURES = 14
_UPPER = np.triu_indices(FEATURES)


def _share(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def features(texts: pa.Array) -> np.ndarray:
    """FEATURES numbers a text; see the module text."""
    parts = [_features(w) for _, _, w in per_slice(texts, textnum.WORK_BYTES)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


def _features(w: textnum.Words) -> np.ndarray:
    n, count = len(w.first) - 1, np.maximum(w.counts, 1)
    owner, data, offsets = owners(w), w.data, w.offsets
    distinct = textnum.distinct_per_text(w.hash, owner, n)
    same = np.zeros(len(w.hash), bool)
    pair = w.hash.copy()
    if len(w.hash) > 1:
        inside = owner[1:] == owner[:-1]
        same[1:] = (w.hash[1:] == w.hash[:-1]) & inside
        pair[1:] = np.where(inside, textnum.mix(w.hash[1:] + textnum.mix(w.hash[:-1])), w.hash[1:])
    pairs = textnum.distinct_per_text(pair, owner, n)
    upper = (data >= 65) & (data <= 90)
    letters = _share(textnum.LETTER[data], offsets)
    symbols = np.isin(data, np.frombuffer(b"#$%&*@^_~<>{}[]\\=+", np.uint8))
    columns = [
        np.log1p(w.counts),
        np.log(count / np.maximum(distinct, 1)),
        np.log(count / np.maximum(pairs, 1)),
        _share(same, w.first),
        _share(upper, offsets) / np.maximum(letters, 1e-9) * (letters > 0),
        np.log1p(200 * _share(data == ord("!"), offsets)),
        np.log1p(200 * _share(symbols, offsets)),
        np.log1p(200 * _share(data == ord("|"), offsets)),
        np.log1p(200 * _share(data == 10, offsets)),
        np.log1p(200 * _share((data >= 48) & (data <= 57), offsets)),
        np.log1p(200 * _share((data == ord(".")) | (data == ord(",")), offsets)),
        np.bincount(owner, w.length, minlength=n) / count,
        _share(data == 32, offsets),
        (w.counts == 0).astype(float),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    threshold: float

    def linear(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features; a row's sum does not depend on the rows beside it."""
        return ((x - self.mean) / self.scale * self.beta).sum(1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.linear(features(texts)) - self.threshold + np.log(CUT / (1 - CUT)))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, FEATURES)


def _at_nodes(rows: DataFrame, model: Ranker) -> dict[int, tuple[np.ndarray, ...]]:
    """Per label: nodes on the axis of scores with their documents, features (standardised) and products of features."""

    def summed(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, y = _rows(batch), batch.column("label").to_numpy().astype(np.int64)
            z, place = (x - model.mean) / model.scale, model.linear(x) / STEP
            node = np.floor(place).astype(np.int64)
            order = np.lexsort((node, y))
            z, y, node, t = z[order], y[order], node[order], (place - node)[order]
            each = np.concatenate([np.ones((len(z), 1)), z, z[:, _UPPER[0]] * z[:, _UPPER[1]]], axis=1)
            starts = np.flatnonzero(np.diff(node, prepend=node[:1] - 1) | np.diff(y, prepend=y[:1]))
            cubic = (-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6)
            for shift, share in zip((-1, 0, 1, 2), cubic, strict=True):
                parts = np.add.reduceat(each * share[:, None], starts) if len(starts) else []
                for k, part in zip(starts, parts, strict=True):
                    at = int(y[k]), int(node[k]) + shift
                    sums[at] = sums[at] + part if at in sums else part
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in sums], pa.int32()), pa.array([b for _, b in sums], pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["label", "node", "v"])

    partial = rows.mapInArrow(summed, "label int, node long, v array<double>").groupBy("label", "node").agg(F.collect_list("v").alias("v"))
    added = F.reduce(F.slice("v", 2, F.size("v")), F.col("v")[0], lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    found = sorted(partial.select("label", "node", added.alias("v")).collect(), key=lambda r: (r.label, r.node))
    out = {}
    for label in (0, 1):
        v = np.array([r.v for r in found if r.label == label])
        products = np.zeros((len(v), FEATURES, FEATURES))
        products[:, _UPPER[0], _UPPER[1]] = products[:, _UPPER[1], _UPPER[0]] = v[:, 1 + FEATURES :]
        out[label] = np.array([r.node for r in found if r.label == label]) * STEP, v[:, 0], v[:, 1 : 1 + FEATURES], products
    return out


def _loss(nodes: dict[int, tuple[np.ndarray, ...]], beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of a pair with the ridge, its gradient and its second derivatives, over all pairs of nodes."""
    (s0, n0, z0, zz0), (s1, n1, z1, zz1) = nodes[0], nodes[1]
    loss, gradient, curve = 0.0, np.zeros(FEATURES), np.zeros((FEATURES, FEATURES))
    for a in range(0, len(s1), 256):  # a block of nodes against all, so that memory is bounded
        b = slice(a, a + 256)
        lead = s1[b, None] - s0[None, :]
        wrong = sigmoid(-lead)
        slope = wrong * (1 - wrong)
        loss += n1[b] @ np.logaddexp(0, -lead) @ n0
        gradient -= (wrong @ n0) @ z1[b] - (n1[b] @ wrong) @ z0
        cross = z1[b].T @ slope @ z0
        curve += np.tensordot(slope @ n0, zz1[b], 1) + np.tensordot(n1[b] @ slope, zz0, 1) - cross - cross.T
    pairs = n0.sum() * n1.sum()
    return loss / pairs + RIDGE * beta @ beta / 2, gradient / pairs + RIDGE * beta, curve / pairs + RIDGE * np.eye(FEATURES)


def fit(docs: DataFrame, labels: DataFrame) -> Ranker:
    before = n_stored()
    try:
        return _fitted(written(labelled_features(docs, labels, "quality", FOLDS, HELD_OUT, features)))
    finally:
        release(docs.sparkSession, before)


def _fitted(rows: DataFrame) -> Ranker:
    at = [F.col("x")[i] for i in range(FEATURES)]
    found = rows.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1), *map(F.avg, at), *map(F.stddev_pop, at)).first()
    if not found[0] or not found[1]:
        return Ranker(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), float(np.log(CUT / (1 - CUT))))
    model = Ranker(np.round(found[2 : 2 + FEATURES], 9), np.round(found[2 + FEATURES :], 9) + 1e-9, np.zeros(FEATURES), 0.0)
    best, step = np.inf, np.zeros(FEATURES)
    for _ in range(ROUNDS):
        loss, gradient, curve = _loss(_at_nodes(rows, model), model.beta)
        if loss > best + 1e-6:  # too far: half the way back
            step = step / 2
            model.beta = model.beta - step
            continue
        best, step = loss, -np.linalg.solve(curve, gradient)
        model.beta = model.beta + step
        if np.abs(step).max() < 1e-6:
            break
    model.beta = np.round(model.beta, 9)

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.linear(_rows(batch)))], ["s"])

    model.threshold = float(np.mean(at_rank(rows.mapInArrow(scored, "s double"), found[0] - 1)))
    return model


def score(text: Column, model: Ranker) -> Column:
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = docs.select("doc_id", score(F.col("text"), fit(docs, labels)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that are not rejected."""
    model = fit(docs, labels)
    return unpack(pack(docs, score=score(F.col("text"), model)).filter(F.col("score") >= CUT))
