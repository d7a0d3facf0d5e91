"""Kernels over whole images. An image is a row with h, w and flat arrays of channel values.

Where pixels meet only themselves or a fixed neighbour the kernel is an
expression or a join (see arrays.py, colors.py). What follows needs the grid of
one image at once: small NumPy helpers inside an Arrow function, an image a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.colors import distance, rgb_to_lab

EDGE = 80.0
METRICS = "struct<readable:boolean,color_ratio:double,intensity_std:double,edge_count:int,black_ratio:double>"


def edge_count(gray: np.ndarray) -> int:
    """Pixels whose gradient, after a [1, 2, 1] blur in both directions, exceeds EDGE."""
    g = np.pad(gray.astype(np.float32), 1, mode="edge")
    g = (g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]) / 4
    g = (g[:-2] + 2 * g[1:-1] + g[2:]) / 4
    p = np.pad(g, 1, mode="edge")
    dx, dy = p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1]
    return int((np.hypot(dx, dy) > EDGE).sum())


def _metrics(h: int, w: int, rgb) -> dict | None:
    if rgb is None or h is None or w is None or h < 8 or w < 8 or len(rgb) != 3 * h * w:
        return {"readable": False}
    a = np.asarray(rgb, np.float64).reshape(h, w, 3)
    high, low = a.max(2) / 255, a.min(2) / 255
    chroma = np.where(high > 1e-6, (high - low) / np.maximum(high, 1e-6), 0)
    gray = (a @ [0.299, 0.587, 0.114]).astype(np.uint8)
    return {
        "readable": True,
        "color_ratio": round(float(((chroma > 0.12) & (high > 0.12)).mean()), 6),
        "intensity_std": round(float(gray.std()), 3),
        "edge_count": edge_count(gray),
        "black_ratio": round(float((gray < 30).mean()), 5),
    }


def qc_metrics(h: Column, w: Column, rgb: Column) -> Column:
    """Metrics of an RGB image; images that are missing, short or under 8 pixels are not readable."""

    @F.arrow_udf(METRICS)
    def measured(hs: pa.Array, ws: pa.Array, images: pa.Array) -> pa.Array:
        kind = pa.struct([("readable", pa.bool_()), ("color_ratio", pa.float64()), ("intensity_std", pa.float64()), ("edge_count", pa.int32()), ("black_ratio", pa.float64())])
        return pa.array([_metrics(a.as_py(), b.as_py(), x.values.to_numpy(zero_copy_only=False) if x.is_valid else None) for a, b, x in zip(hs, ws, images, strict=True)], kind)

    return measured(h, w, rgb)


def connected(labels: np.ndarray) -> np.ndarray:
    """4-connected components of equal labels: the smallest pixel number of each, by repeated minima along rows and columns."""
    out = np.arange(labels.size).reshape(labels.shape)
    same_x, same_y = labels[:, 1:] == labels[:, :-1], labels[1:] == labels[:-1]
    while True:
        before = out.copy()
        for a, b, same in ((out[:, :-1], out[:, 1:], same_x), (out[:-1], out[1:], same_y)):
            low = np.minimum(a, b)
            np.minimum(a, low, out=a, where=same)
            np.minimum(b, low, out=b, where=same)
        out = out.ravel()[out]  # jump to the label of the label
        if (out == before).all():
            return out


def openness(white: np.ndarray) -> float:
    """Share of white pixels that can be reached from the border over white pixels; 0 without white."""
    parts = connected(white.astype(np.int8))
    border = np.concatenate([parts[0], parts[-1], parts[:, 0], parts[:, -1]])
    return float((np.isin(parts, border) & white).sum() / white.sum()) if white.any() else 0.0


def openness_ratio(h: Column, w: Column, gray: Column, white_from: int = 250) -> Column:
    @F.arrow_udf("double")
    def measured(hs: pa.Array, ws: pa.Array, images: pa.Array) -> pa.Array:
        return pa.array([openness(x.values.to_numpy().reshape(a.as_py(), b.as_py()) >= white_from) for a, b, x in zip(hs, ws, images, strict=True)])

    return measured(h, w, gray)


def in_groups(rows: DataFrame, by: list[str], order: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """work(table, at) of whole groups in order: group i is the rows from at[i] to at[i + 1].

    A task's rows arrive sorted; the groups that an Arrow batch completes go through
    work together, and only the group that it leaves open is carried on. So many
    small groups cost little more than their rows, and a large one is held alone.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(_begins(batch, by))
            joined = bool(held) and all(held[-1].column(c)[-1] == batch.column(c)[0] or not (held[-1].column(c)[-1].is_valid or batch.column(c)[0].is_valid) for c in by)
            if joined and len(starts) == 1:
                held.append(batch)
                continue
            if held:
                cut = int(starts[1]) if joined else 0
                last = pa.Table.from_batches([*held, batch.slice(0, cut)])
                yield work(last.combine_chunks(), np.array([0, last.num_rows]))
                starts = starts[1:] if joined else starts
            if len(starts) > 1:
                whole = batch.slice(int(starts[0]), int(starts[-1] - starts[0]))
                yield work(pa.Table.from_batches([whole]), starts - starts[0])
            held = [batch.slice(int(starts[-1]))]
        if held:
            last = pa.Table.from_batches(held).combine_chunks()
            yield work(last, np.array([0, last.num_rows]))

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def _begins(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Whether each row is the first of its group."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in by:
        c = batch.column(name)
        same = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        neither = pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1])).to_numpy(zero_copy_only=False)
        new[1:] |= ~(same | neither)
    return new


def part_numbers(y: np.ndarray, x: np.ndarray, label: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The component of each pixel of several images. Images of equal width lie one below the other, with a row between that belongs to none."""
    n, out = np.diff(at), np.empty(len(y), np.int64)
    h, w = np.maximum.reduceat(y, at[:-1]) + 1, np.maximum.reduceat(x, at[:-1]) + 1
    for width in np.unique(w):
        mine = np.flatnonzero(w == width)
        top = np.cumsum(h[mine] + 1) - h[mine] - 1
        rows = np.repeat(w == width, n)
        down = np.repeat(top, n[mine])
        grid = np.full((int((h[mine] + 1).sum()), int(width)), -1, np.int64)
        grid[top + h[mine]] = np.iinfo(np.int64).min
        grid[y[rows] + down, x[rows]] = label[rows]
        out[rows] = connected(grid)[y[rows] + down, x[rows]] - down * width
    return out


def components(pixels: DataFrame) -> DataFrame:
    """(image, y, x, region) with `part`: the component of each pixel, an image a group (an image fits one task)."""

    def label(table: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        y, x, region = (table[c].to_numpy().astype(np.int64) for c in ("y", "x", "region"))
        found = [table["image"].combine_chunks(), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(region, pa.int32()), pa.array(part_numbers(y, x, region, at))]
        return pa.RecordBatch.from_arrays(found, ["image", "y", "x", "region", "part"])

    rows = pixels.select(F.col("image").cast("long").alias("image"), "y", "x", "region")
    return in_groups(rows, ["image"], [], label, "image long, y int, x int, region int, part long")


def around(pixels: DataFrame, axis: str, **extremes: tuple[str, str]) -> DataFrame:
    """pixels with the smallest or largest value of each pixel and its two neighbours along an axis (`x` or `y`), as far as they are in the image: name=(`min` or `max`, column)."""
    across = "y" if axis == "x" else "x"
    near = Window.partitionBy("image", across).orderBy(axis).rangeBetween(-1, 1)
    return pixels.select("*", *(getattr(F, how)(value).over(near).alias(name) for name, (how, value) in extremes.items()))


def interior(pixels: DataFrame) -> DataFrame:
    """(image, y, x, region) with `interior`: whether all of the 3 x 3 pixels around, as far as in the image, are of the same region. Rows, then columns: two windows."""
    rows = around(pixels, "x", __low=("min", "region"), __high=("max", "region"))
    both = around(rows, "y", __least=("min", "__low"), __most=("max", "__high"))
    return both.withColumn("interior", F.col("__least") == F.col("__most")).drop("__low", "__high", "__least", "__most")


def line_mask(pixels: DataFrame, lightness: str, dark: float = 25.0) -> DataFrame:
    """(image, y, x, ...) with `line`: dark pixels after a 3 x 3 closing (largest, then smallest of the neighbourhood)."""
    return closed(pixels.withColumn("__dark", (F.col(lightness) < dark).cast("int")), "__dark", "line").drop("__dark")


def closed(pixels: DataFrame, mask: str, name: str) -> DataFrame:
    """pixels with `name`: a 0/1 mask after a 3 x 3 closing; neighbouring steps share their axis, so three shuffles make four steps."""
    grown = around(around(pixels, "x", __1=("max", mask)), "y", __2=("max", "__1"))
    shrunk = around(around(grown, "y", __3=("min", "__2")), "x", __4=("min", "__3"))
    return shrunk.withColumn(name, F.col("__4") == 1).drop("__1", "__2", "__3", "__4")


def ink_regions(pixels: DataFrame, line: str, least: float = 0.50) -> DataFrame:
    """image, region, overlap, ink: regions of which at least that share are line pixels."""
    share = pixels.groupBy("image", "region").agg(F.avg(F.col(line).cast("int")).alias("overlap"))
    return share.withColumn("ink", F.col("overlap") >= least)


# Fixed value: the green of the key colour (red, green, blue).
KEY_COLOR = (0, 177, 64)


def key_mask(r: Column, g: Column, b: Column, limit: float) -> Column:
    """Whether a pixel's Lab colour is nearer to the key colour than limit."""
    lab = lambda c: F.array(c["L"], c["a"], c["b"])
    return distance(lab(rgb_to_lab(r, g, b)), lab(rgb_to_lab(*(F.lit(v) for v in KEY_COLOR)))) < limit


def crayons(pixels: DataFrame, color: str, ink: str) -> DataFrame:
    """image, crayons map<hex, pixels> without the pixels of ink regions; the colours of one image are few."""
    counts = pixels.filter(~F.col(ink)).groupBy("image", color).agg(F.count("*").alias("n"))
    return counts.groupBy("image").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(color, "n")))).alias("crayons"))


def median_difference(regions: DataFrame, delta: str, left_out: Column) -> DataFrame:
    """image, median colour difference of the regions that are not left out; 0 if none is."""
    return regions.groupBy("image").agg(F.coalesce(F.median(F.when(~left_out, F.col(delta))), F.lit(0.0)).alias("median_delta"))


# The 8 x 8 ordered dithering matrix, built by its doubling rule.
def bayer(n: int = 8) -> list[list[int]]:
    m = np.zeros((1, 1), int)
    while len(m) < n:
        m = np.block([[4 * m, 4 * m + 2], [4 * m + 3, 4 * m + 1]])
    return m.tolist()


def dither(value: Column, y: Column, x: Column) -> Column:
    """Black (0) or white (255) by the ordered threshold of a pixel's place."""
    table = F.array(*(F.lit(v) for row in bayer() for v in row))
    threshold = (F.get(table, (F.pmod(y, F.lit(8)) * 8 + F.pmod(x, F.lit(8))).cast("int")) + 0.5) * (255 / 64)
    return F.when(value > threshold, 255).otherwise(0)


def merge_regions(regions: DataFrame, edges: DataFrame, limit: float, passes: int = 8) -> DataFrame:
    """image, region, target: neighbouring regions closer than limit in Lab merge, closest first, means anew each pass.

    regions (image, region, area, L, a, b), edges (image, a, b). The outcome
    depends on the order of merges, so an image's region graph is one group.
    """

    def merge(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        target = {int(r): int(r) for r in left.region}

        def root(r: int) -> int:
            while target[r] != r:
                r = target[r]
            return r

        color = {int(r.region): (float(r.area), np.array([r.L, r.a, r.b], float)) for r in left.itertuples()}
        for _ in range(passes):
            pairs = {tuple(sorted((root(int(e.a)), root(int(e.b))))) for e in right.itertuples()}
            close = sorted((float(np.linalg.norm(color[a][1] - color[b][1])), a, b) for a, b in pairs if a != b)
            close = [c for c in close if c[0] < limit]
            for _, a, b in close:
                a, b = sorted((root(a), root(b)))
                if a != b and np.linalg.norm(color[a][1] - color[b][1]) < limit:
                    (m, x), (n, y) = color[a], color[b]
                    color[a], target[b] = (m + n, (m * x + n * y) / (m + n)), a
            if not close:
                break
        return pd.DataFrame({"image": left.image, "region": left.region, "target": [root(int(r)) for r in left.region]})

    other = edges.select(F.col("image").alias("of"), "a", "b")
    return regions.groupBy("image").cogroup(other.groupBy("of")).applyInPandas(merge, "image long, region int, target int")


# Shares of an error that go right, below left, below and below right.
DIFFUSED = ((0, 1, 7 / 16), (1, -1, 3 / 16), (1, 0, 5 / 16), (1, 1, 1 / 16))


def diffused(gray: np.ndarray) -> np.ndarray:
    """0/255 by error diffusion from left to right and top to bottom. Pixels of equal x + 2y do not depend on each other and go together."""
    h, w = gray.shape
    a = np.zeros((h + 1, w + 2))  # margins take what leaves the image
    a[:h, 1 : w + 1] = gray
    for t in range(w + 2 * (h - 1)):
        y = np.arange(max(0, (t - w + 2) // 2), min(h - 1, t // 2) + 1)
        x = t - 2 * y + 1
        new = np.where(a[y, x] >= 128, 255.0, 0.0)
        error = a[y, x] - new
        a[y, x] = new
        for dy, dx, share in DIFFUSED:
            a[y + dy, x + dx] += error * share  # one target a source within a wave
    return a[:h, 1 : w + 1].astype(np.uint8)


def stippled(gray: np.ndarray, least: float, seed: int) -> np.ndarray:
    """Pixels (y, x) chosen in a seeded order, darker ones likelier to be first, none nearer than `least` to another. A grid of cells with at most one point each finds those near."""
    rng = np.random.default_rng(seed)
    ys, xs = np.nonzero(gray < 255)
    order = np.argsort(-np.log(rng.random(len(ys))) / (255.0 - gray[ys, xs]), kind="stable")
    cell = least / np.sqrt(2)
    reach, taken, points = int(np.ceil(least / cell)), {}, []
    for y, x in zip(ys[order].tolist(), xs[order].tolist()):
        cy, cx = int(y / cell), int(x / cell)
        near = (taken.get((j, i)) for j in range(cy - reach, cy + reach + 1) for i in range(cx - reach, cx + reach + 1))
        if all(p is None or (p[0] - y) ** 2 + (p[1] - x) ** 2 >= least * least for p in near):
            taken[cy, cx] = (y, x)
            points.append((y, x))
    return np.array(sorted(points), np.int32).reshape(-1, 2)


def _grids(hs: pa.Array, ws: pa.Array, images: pa.Array):
    for h, w, x in zip(hs, ws, images, strict=True):
        yield x.values.to_numpy(zero_copy_only=False).reshape(h.as_py(), w.as_py())


def diffuse(h: Column, w: Column, gray: Column) -> Column:
    """array<int>: the image in black (0) and white (255) by error diffusion."""

    @F.arrow_udf("array<int>")
    def done(hs: pa.Array, ws: pa.Array, images: pa.Array) -> pa.Array:
        return pa.array([diffused(g).ravel().astype(np.int32) for g in _grids(hs, ws, images)], pa.list_(pa.int32()))

    return done(h, w, gray)


def stipple(h: Column, w: Column, gray: Column, least: float, seed: Column) -> Column:
    """array<struct<y, x>>: points for the image's darkness, at least `least` apart; equal seeds give equal points."""

    @F.arrow_udf("array<struct<y:int,x:int>>")
    def done(hs: pa.Array, ws: pa.Array, images: pa.Array, seeds: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("y", pa.int32()), ("x", pa.int32())]))
        return pa.array([[{"y": y, "x": x} for y, x in stippled(g, least, s.as_py()).tolist()] for g, s in zip(_grids(hs, ws, images), seeds, strict=True)], kind)

    return done(h, w, gray, seed)


# Lightness below which a pixel is black, and above which it is white; grey lies between.
BLACK, WHITE = 80, 200


def _cells(pixels: DataFrame, gray: str, cell: int, used: Column) -> DataFrame:
    """pixels with __mean (of the used pixels of their square cell), and the cell's centre as __my, __mx."""
    cy, cx = F.floor(F.col("y") / cell), F.floor(F.col("x") / cell)
    cells = pixels.groupBy("image", cy.alias("__cy"), cx.alias("__cx")).agg(
        F.avg(F.when(used, F.col(gray))).alias("__mean"), ((F.min("y") + F.max("y") + 1) / 2).alias("__my"), ((F.min("x") + F.max("x") + 1) / 2).alias("__mx")
    )
    return pixels.withColumn("__cy", cy).withColumn("__cx", cx).join(cells, ["image", "__cy", "__cx"])


def _darkness(mean: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (high - mean) / (high - low)))


def _in_dot(cell: int, low: float, high: float) -> Column:
    radius = _darkness(F.col("__mean"), low, high) * (cell / 2 * 0.95)
    y, x = F.col("y") - F.col("__my"), F.col("x") - F.col("__mx")
    return F.coalesce((radius >= 0.5) & (y * y + x * x <= radius * radius), F.lit(False))


def halftone(pixels: DataFrame, gray: str, cell: int, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """pixels with `dot` (0 or 255): in each cell a black disk about its centre, with a radius in proportion to the darkness of its mean between high and low (0.95 of half a cell at most, none under half a pixel)."""
    joined = _cells(pixels, gray, cell, F.lit(True))
    return joined.select(*pixels.columns, F.when(_in_dot(cell, low, high), 0).otherwise(255).alias("dot"))


def gray_replaced(pixels: DataFrame, lightness: str, how: str, cell: int = 8, seed: int = 42) -> DataFrame:
    """pixels with `out` (0 or 255): black stays black, white white, and grey becomes

    `white`; `dots` (a disk a cell, by the mean of its grey pixels); `hatching` (lines
    of equal x + y, 2 to 8 pixels apart by the cell's mean); or `stippling` (points
    drawn by a digest of seed, image and place, likelier where it is dark).
    """
    light = F.col(lightness)
    grey = light.between(BLACK, WHITE)
    base = F.when(light < BLACK, 0).otherwise(255)
    if how == "white":
        return pixels.withColumn("out", base)
    if how == "stippling":
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in ("image", "y", "x"))))
        drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**32
        return pixels.withColumn("out", F.when(grey & (drawn < _darkness(light, BLACK, WHITE)), 0).otherwise(base))
    joined = _cells(pixels, lightness, cell, grey)
    if how == "dots":
        black = _in_dot(cell, BLACK, WHITE)
    elif how == "hatching":
        apart = F.greatest(F.lit(2), F.bround(8 - 6 * _darkness(F.col("__mean"), BLACK, WHITE), 0).cast("int"))
        black = grey & ((F.col("x") + F.col("y")) % apart == 0)
    else:
        raise ValueError(f"no way to replace grey: {how}")
    return joined.select(*pixels.columns, F.when(black, 0).otherwise(base).alias("out"))


def palette(pixels: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """cluster, L, a, b: k-means colours of Lab pixels (columns L, a, b), fitted by Spark."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=["L", "a", "b"], outputCol="features").transform(pixels)
    centers = KMeans(k=k, seed=seed).fit(points).clusterCenters()
    return pixels.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centers)], "cluster int, L double, a double, b double")
