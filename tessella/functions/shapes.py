"""Lines and polygons as array<struct<x, y>>: simplification and smoothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def kept_points(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of an open line stay: both ends, and in each stretch the point farthest from its chord while that is beyond the tolerance (of equals the first). The stretches still to be looked at are a stack, so the number of points has no limit."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        start, chord, inner = points[a], points[b] - points[a], points[a + 1 : b]
        length2 = chord @ chord
        # nearest place on the chord; a stretch that ends where it began is measured from that point
        t = np.clip((inner - start) @ chord / length2, 0, 1)[:, None] if length2 else 0.0
        far = ((inner - start - t * chord) ** 2).sum(1)
        k = int(far.argmax())
        if far[k] > tolerance * tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplified(points: Column, tolerance: float) -> Column:
    """The line without the points that are no farther than the tolerance from what is left. Lines of fewer than three points stay; null stays null."""

    @F.arrow_udf(POINTS)
    def thinned(lines: pa.Array) -> pa.Array:
        flat = lines.flatten()
        xy = np.column_stack([flat.field(f).to_numpy(zero_copy_only=False) for f in ("x", "y")]).astype(float)
        sizes = lines.value_lengths().fill_null(0).to_numpy()
        ends = np.cumsum(sizes)
        keep = np.ones(len(xy), bool)
        for n, end in zip(sizes, ends):
            if n > 2:
                keep[end - n : end] = kept_points(xy[end - n : end], tolerance)
        at = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
        out = pa.StructArray.from_arrays([pa.array(xy[keep, 0]), pa.array(xy[keep, 1])], names=["x", "y"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), out, mask=lines.is_null())

    return thinned(points.cast(POINTS))


def _between(p: Column, q: Column, t: float) -> Column:
    return F.named_struct(F.lit("x"), (1 - t) * p["x"] + t * q["x"], F.lit("y"), (1 - t) * p["y"] + t * q["y"])


def chaikin_open(points: Column) -> Column:
    """One corner-cutting step of an open line: its ends stay, each edge gives its points at a quarter and at three quarters."""
    size = F.size(points)
    edges = F.zip_with(F.slice(points, F.lit(1), size - 1), F.slice(points, F.lit(2), size - 1), lambda p, q: F.array(_between(p, q, 0.25), _between(p, q, 0.75)))
    return F.when(size < 2, points).otherwise(F.concat(F.slice(points, F.lit(1), F.lit(1)), F.flatten(edges), F.slice(points, size, F.lit(1))))


def near_edge(points: Column, h: Column, w: Column, margin: float = 3.0) -> Column:
    """Whether a point is within the margin of the edge of an image of h x w pixels."""
    return F.exists(points, lambda p: (p["y"] < margin) | (p["y"] > h - 1 - margin) | (p["x"] < margin) | (p["x"] > w - 1 - margin))


def smoothed(points: Column, h: Column, w: Column, tolerance: float, steps: int = 1) -> Column:
    """An open line simplified and its corners cut `steps` times, only simplified near the image's edge."""
    thin = simplified(points, tolerance)
    cut = thin
    for _ in range(steps):
        cut = chaikin_open(cut)
    return F.when(near_edge(thin, h, w), thin).otherwise(cut)
