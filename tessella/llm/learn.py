"""What the trained operators share: training rows, order statistics of their scores, and small fits on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


#: Parts into which a round of `at_rank` splits the values.
BINS = 4096


def known_labels(labels: DataFrame, label: str, parts: int, held_out: int) -> DataFrame:
    """(doc_id, label) of the ids outside the held-out fold; an id whose labels contradict each other has none."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), parts) != held_out))
    return known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").select("doc_id", "label")


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, features: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """(x, label): the features of every labelled document outside the held-out fold.

    They are computed where the texts are read, so that no text is shuffled. An
    id counts once, with the smallest of its rows of features.
    """

    def featured(batches):
        for batch in batches:
            x = features(batch.column(1))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["doc_id", "x"])

    learned = docs.filter(fold(F.col("doc_id"), parts) != held_out).select("doc_id", "text")
    rows = learned.mapInArrow(featured, f"doc_id {learned.schema['doc_id'].dataType.simpleString()}, x array<double>")
    return rows.groupBy("doc_id").agg(F.min("x").alias("x")).join(known_labels(labels, label, parts, held_out), "doc_id").select("x", "label")


def at_rank(values: DataFrame, rank: int) -> tuple[float, float]:
    """The value of that rank (from 0) of the column `s`, and the next greater one (itself if there is none).

    Values are counted by BINS equal parts of their range, then those of the part
    that has the rank, until it holds one value: no sort, and BINS rows to the driver.
    """
    low, high = values.agg(F.min("s"), F.max("s")).first()
    above, before = None, 0
    while low < high:
        part = F.least(F.floor((F.col("s") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        found = values.filter(F.col("s").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("part").collect()
        at = int(np.searchsorted(np.cumsum([r.n for r in found]), rank - before, side="right"))
        before += sum(r.n for r in found[:at])
        low, high = found[at].low, found[at].high
        above = found[at + 1].low if at + 1 < len(found) else above
    return low, low if above is None else above


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most per_class documents of each label, and the label counts of all training ids.

    Only ids outside the held-out fold are taken; of those the ones with the
    smallest hash of the id, so the sample is the same on every run. An id counts
    once, with the smallest of its texts; an id whose labels contradict each other
    has none. So ids and rows are bounded by 2 * per_class, and broadcasting the
    ids is safe.
    """
    known = known_labels(labels, label, parts, held_out)
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; no intercept of its own."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
