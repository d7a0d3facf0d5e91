"""Pixels as rows (image, y, x, ...): distances and nearest pixels, backgrounds, borders, palettes, merged regions.

An image's rows and columns are spread over tasks where the work allows it:
distances need one row, then one column at a time. Connected parts, borders
walked from junction to junction and merges that depend on their order take an
image as one group, or less of it: its regions, border sides or colours.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.colors import distance
from tessella.operators import images

#: Fixed value: thickness of an image without lines.
NO_LINE = 3.0
#: Share of an arc on the line mask that makes it ink; Lab deviation of a mixed part; colours it is split into.
INK_ARC, MIXED, SPLIT = 0.60, 25.0, 4


def lower_envelope(ys: list[int], cost: list[int | None]) -> list[int | None]:
    """For each of the ascending ys the index k with the smallest cost[k] + (y - ys[k])², of equals the smallest; None without any cost. Linear in their number."""
    best, begins = [], []  # sources in order, and the first y from which each is the best
    for q, c in enumerate(cost):
        if c is None:
            continue
        begin = None
        while best:
            v = best[-1]
            begin = (c + ys[q] ** 2 - cost[v] - ys[v] ** 2) // (2 * (ys[q] - ys[v])) + 1
            if begins[-1] is None or begin > begins[-1]:
                break
            best.pop(), begins.pop()
            begin = None
        best.append(q), begins.append(begin)
    out, at = [], 0
    for y in ys:
        while at + 1 < len(best) and begins[at + 1] <= y:
            at += 1
        out.append(best[at] if best else None)
    return out


def _column_sources(ys: Column, costs: Column) -> Column:
    """array<int>: the best source's place in its column for each pixel of the column."""

    @F.arrow_udf("array<int>")
    def found(ys: pa.Array, costs: pa.Array) -> pa.Array:
        return pa.array([lower_envelope(y.as_py(), c.as_py()) for y, c in zip(ys, costs, strict=True)], pa.list_(pa.int32()))

    return found(ys, costs)


def nearest(pixels: DataFrame, source: Column, *carried: str) -> DataFrame:
    """pixels with `near` struct<y, x, carried columns> and `d2`, the squared distance: of the nearest pixel for which source holds, of equals the one of smaller y, then x. Null where the image has none.

    Exact and separable: the nearest source in the pixel's own row by two running
    windows, then the lower envelope of the parabolas of a column's rows. A task
    needs one row or one column of an image at a time.
    """
    row = Window.partitionBy("image", "y").orderBy("x")
    mark = F.when(source, F.struct("y", "x", *carried))
    left = F.last(mark, True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(mark, True).over(row.rowsBetween(0, Window.unboundedFollowing))
    in_row = pixels.select(F.struct(*pixels.columns).alias("row"), left.alias("l"), right.alias("r"))
    to_left = F.col("row.x") - F.col("l.x") <= F.col("r.x") - F.col("row.x")
    chosen = in_row.select("row", F.when(F.col("r").isNull() | to_left, F.col("l")).otherwise(F.col("r")).alias("s"))
    columns = chosen.groupBy(F.col("row.image").alias("i"), F.col("row.x").alias("x")).agg(F.array_sort(F.collect_list(F.struct(F.col("row.y").alias("y"), "row", "s"))).alias("c"))
    cost = F.transform("c", lambda p: ((p["row"]["x"] - p["s"]["x"]) * (p["row"]["x"] - p["s"]["x"])).cast("long"))
    found = columns.select("c", _column_sources(F.transform("c", lambda p: p["y"].cast("long")), cost).alias("k"))
    met = found.select(F.explode(F.zip_with("c", "k", lambda p, k: F.struct(p["row"].alias("row"), F.get("c", k)["s"].alias("near")))).alias("m"))
    dy, dx = F.col("m.row.y") - F.col("m.near.y"), F.col("m.row.x") - F.col("m.near.x")
    return met.select("m.row.*", "m.near", (dy * dy + dx * dx).cast("long").alias("d2"))


def filled(pixels: DataFrame, label: str, empty: Column, limit: float | None = None) -> DataFrame:
    """pixels in which empty ones have the label of the nearest other pixel, if it is within the limit (a distance); else they stay."""
    near = nearest(pixels, ~empty, label)
    reached = F.col("near").isNotNull() & (F.lit(True) if limit is None else F.col("d2") <= limit * limit)
    return near.withColumn(label, F.when(empty & reached, F.col(f"near.{label}")).otherwise(F.col(label))).drop("near", "d2")


def thickness(pixels: DataFrame, line: str) -> DataFrame:
    """image, thickness: twice the median distance of line pixels to the nearest other pixel; NO_LINE without line pixels, null if all are."""
    near = nearest(pixels, ~F.col(line))
    median = 2 * F.median(F.when(F.col(line), F.sqrt("d2")))
    return near.groupBy("image").agg(F.when(F.count_if(line) == 0, NO_LINE).otherwise(median).alias("thickness"))


def on_border(pixels: DataFrame) -> DataFrame:
    """pixels with `border`: whether they are in the first or last row or column of their image."""
    whole = Window.partitionBy("image")
    inside = F.col("y").isin(F.min("y").over(whole), F.max("y").over(whole)) | F.col("x").isin(F.min("x").over(whole), F.max("x").over(whole))
    return pixels.withColumn("border", inside)


def background_label(pixels: DataFrame, label: str) -> DataFrame:
    """image, background: the most frequent label of its border pixels, negative ones (ink) left out, of equals the smallest."""
    counts = on_border(pixels).filter(F.col("border") & (F.col(label) >= 0)).groupBy("image", label).agg(F.count("*").alias("n"))
    return counts.groupBy("image").agg(F.max_by(label, F.struct("n", -F.col(label))).alias("background"))


def _with_background(pixels: DataFrame, label: str) -> DataFrame:
    """pixels with `background` as in background_label, null where an image has none; by windows, so pixels are computed once."""
    counted = on_border(pixels).withColumn("__n", F.count_if(F.col("border") & (F.col(label) >= 0)).over(Window.partitionBy("image", label)))
    found = F.max_by(F.when(F.col("__n") > 0, F.col(label)), F.when(F.col("__n") > 0, F.struct("__n", -F.col(label)))).over(Window.partitionBy("image"))
    return counted.withColumn("background", found).drop("border", "__n")


def _parts(pixels: DataFrame, label: str) -> DataFrame:
    """pixels with `part` (connected pixels of equal label) and `open` (whether the part reaches the border). Pixels are computed once: their other columns go along."""

    def found(table: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        y, x, region = (table[c].to_numpy().astype(np.int64) for c in ("__y", "__x", "__label"))
        part = images.part_numbers(y, x, region, at)
        return pa.RecordBatch.from_arrays([table["row"].combine_chunks(), pa.array(part)], ["row", "part"])

    rows = pixels.select(F.col("image").alias("__image"), F.col("y").cast("int").alias("__y"), F.col("x").cast("int").alias("__x"), F.col(label).cast("int").alias("__label"), F.struct(*pixels.columns).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    parts = images.in_groups(rows, ["__image"], [], found, f"row {kind}, part long").select("row.*", "part")
    return on_border(parts).withColumn("open", F.max("border").over(Window.partitionBy("image", "part"))).drop("border")


def isolated_background(pixels: DataFrame, label: str) -> DataFrame:
    """pixels (image, y, x, label) in which parts of the background's label that do not reach the border have the label of the nearest pixel that is neither ink nor background."""
    marked = _with_background(_parts(pixels, label), label)
    enclosed = F.coalesce((F.col(label) == F.col("background")) & ~F.col("open"), F.lit(False))
    other = F.coalesce((F.col(label) >= 0) & (F.col(label) != F.col("background")), F.lit(False))
    near = nearest(marked.withColumn("enclosed", enclosed).withColumn("other", other), F.col("other"), label)
    changed = F.when(F.col("enclosed") & F.col("near").isNotNull(), F.col(f"near.{label}")).otherwise(F.col(label))
    return near.select(*(changed.alias(c) if c == label else c for c in pixels.columns))


def without_holes(pixels: DataFrame, mask: str) -> DataFrame:
    """pixels with a 0/1 mask in which parts of 0 that do not reach the border are 1."""
    parts = _parts(pixels, mask)
    return parts.select(*(F.when(~F.col("open"), 1).otherwise(F.col(mask)).cast("int").alias(mask) if c == mask else c for c in pixels.columns))


def largest_part(pixels: DataFrame, mask: str) -> DataFrame:
    """pixels with a 0/1 mask of which the largest connected part stays, of equals the one that comes first."""
    parts = _parts(pixels, mask)
    sized = parts.withColumn("n", F.when(F.col(mask) == 1, F.count("*").over(Window.partitionBy("image", "part"))))
    sized = sized.withColumn("kept", F.max_by("part", F.when(F.col("n").isNotNull(), F.struct("n", -F.col("part")))).over(Window.partitionBy("image")))
    kept = F.coalesce((F.col(mask) == 1) & (F.col("part") == F.col("kept")), F.lit(False)).cast("int")
    return sized.select(*(kept.alias(mask) if c == mask else c for c in pixels.columns))


# palettes: k-means over an image's colours


def _drawn(rng: np.random.Generator, shares: np.ndarray) -> int:
    """A place drawn by shares, as rng.choice draws it, without its checks of each call."""
    reached = shares.cumsum()
    return int((reached / reached[-1]).searchsorted(rng.random(), side="right"))


def _clusters(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator, starts: int, rounds: int) -> tuple[float, np.ndarray]:
    """Inertia and centres of the best of several starts (far points are likelier seeds)."""
    outcomes = []
    k = min(k, len(points))
    for _ in range(starts):
        centers = points[[_drawn(rng, weights / weights.sum())]]
        while len(centers) < k:
            far = weights * ((points[:, None] - centers) ** 2).sum(2).min(1)
            centers = np.vstack([centers, points[_drawn(rng, far / far.sum())]])
        for _ in range(rounds):
            of = ((points[:, None] - centers) ** 2).sum(2).argmin(1)
            moved = centers.copy()
            for c in range(k):
                own = of == c
                if own.any():
                    w = weights[own]
                    moved[c] = (points[own] * w[:, None]).sum(0) / w.sum()
            if (moved == centers).all():
                break
            centers = moved
        outcomes.append((float((weights * ((points[:, None] - centers) ** 2).sum(2).min(1)).sum()), len(outcomes), centers))
    inertia, _, centers = min(outcomes, key=lambda x: x[:2])
    return inertia, centers[np.lexsort(centers.T[::-1])]


def palettes(pixels: DataFrame, by: list[str], channels: list[str], k: int, seed: int = 42, starts: int = 4, rounds: int = 100) -> DataFrame:
    """by, centers array<array<double>> (in ascending order), inertia: k-means of each group's colours.

    Equal colours are counted before the shuffle and a group is its different
    colours in order, so outcome and memory do not depend on partitions or on the
    number of pixels. The seed is joined with the group's names.
    """
    counted = pixels.groupBy(*by, *(F.col(c).cast("double").alias(c) for c in channels)).agg(F.count("*").alias("__n"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.select(*by).schema)

    def fit(table: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        points = np.column_stack([table[c].to_numpy() for c in channels])
        weights = table["__n"].to_numpy().astype(float)
        heads = table.select(by).take(at[:-1])
        centers, inertia = [], []
        for key, a, b in zip(zip(*(heads[c].to_pylist() for c in by)), at[:-1], at[1:]):
            rng = np.random.default_rng([seed, zlib.crc32(repr([str(x) for x in key]).encode())])
            best, found = _clusters(points[a:b], weights[a:b], k, rng, starts, rounds)
            centers.append(found.tolist())
            inertia.append(best)
        return pa.RecordBatch.from_arrays([*(heads[c].combine_chunks() for c in by), pa.array(centers, pa.list_(pa.list_(pa.float64()))), pa.array(inertia, pa.float64())], [*by, "centers", "inertia"])

    return images.in_groups(counted, by, channels, fit, f"{names}, centers array<array<double>>, inertia double")


def assigned(pixels: DataFrame, found: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """pixels with `cluster`: the number (from 0) of the nearest centre of their group, of equals the smallest."""
    color = F.array(*(F.col(c).cast("double") for c in channels))
    scored = F.transform("centers", lambda c, i: F.struct(distance(color, c).alias("d"), i.alias("i")))
    return pixels.join(found.select(*by, "centers"), by).withColumn("cluster", F.array_min(scored)["i"]).drop("centers")


def silhouettes(pixels: DataFrame, channels: list[str], seed: int = 42) -> DataFrame:
    """(image, y, x) with `inside` 0/1: two colours an image, the one that holds most of the border is outside; closed, the largest part, without holes."""
    found = palettes(pixels, ["image"], channels, 2, seed)
    two = assigned(pixels, found, ["image"], channels)
    mask = _with_background(two, "cluster").filter("background is not null").select("image", "y", "x", (F.col("cluster") != F.col("background")).cast("int").alias("raw"))
    whole = images.closed(mask, "raw", "inside").select("image", "y", "x", F.col("inside").cast("int").alias("inside"))
    return without_holes(largest_part(whole, "inside"), "inside")


def split_mixed(pixels: DataFrame, channels: list[str], limit: float = MIXED, k: int = SPLIT, least: int = 50, share: float = 0.05, seed: int = 42) -> DataFrame:
    """(image, part, y, x, ...) with `piece`: parts whose colours deviate by more than limit are cut into connected pieces of k colours, others are null.

    Colours under `share` of a part and pieces under `least` pixels get none; a part
    with fewer than two pieces stays whole.
    """
    deviation = F.sqrt(sum(F.var_pop(c) for c in channels))
    mixed = pixels.groupBy("image", "part").agg(deviation.alias("__dev"), F.count("*").alias("__area")).filter((F.col("__dev") > limit) & (F.col("__area") >= max(k, 4)))
    inside = pixels.join(mixed.select("image", "part", "__area"), ["image", "part"])
    colored = assigned(inside, palettes(inside, ["image", "part"], channels, k, seed), ["image", "part"], channels)
    enough = F.count("*").over(Window.partitionBy("image", "part", "cluster")) >= F.greatest(F.lit(least), F.floor(F.col("__area") * share))
    kept = colored.withColumn("__enough", enough).filter("__enough").withColumn("__name", F.dense_rank().over(Window.partitionBy("image").orderBy("part", "cluster")))
    pieces = images.components(kept.select("image", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("__name").cast("int").alias("region"))).select("image", "y", "x", F.col("part").alias("piece"))
    sized = pieces.withColumn("n", F.count("*").over(Window.partitionBy("image", "piece"))).filter(F.col("n") >= least).drop("n")
    named = inside.select("image", "part", "y", "x").join(sized, ["image", "y", "x"])
    several = named.groupBy("image", "part").agg(F.countDistinct("piece").alias("n")).filter("n > 1").select("image", "part")
    return pixels.join(named.join(several, ["image", "part"]), ["image", "part", "y", "x"], "left")


# regions merged in an order


def _absorbed(area: dict, color: dict, compact: dict, near: dict, least: int, contrast: float, passes: int) -> tuple[dict, set, set]:
    """Where each region went, which were forced and which stay for their contrast. The live graph is contracted at every merge."""
    target, forced, kept = {}, set(), set()
    for _ in range(passes):
        moved = False
        for _, r in sorted((area[r], r) for r in area if r not in kept and (area[r] < least or not compact[r])):
            if r in kept or r not in area or not near[r] or (compact[r] and area[r] >= least):
                continue
            if not compact[r]:
                forced.add(r)
            elif np.mean([np.linalg.norm(color[r] - color[o]) for o in near[r]]) >= contrast:
                kept.add(r)
                continue
            into = max(near[r], key=lambda o: (area[o], -o))
            color[into] = (color[into] * area[into] + color[r] * area[r]) / (area[into] + area[r])
            area[into] += area.pop(r)
            for o in near.pop(r):
                near[o].discard(r)
                if o != into:
                    near[o].add(into)
                    near[into].add(o)
            target[r], moved = into, True
        if not moved:
            break
    return target, forced, kept


def _by_graph(regions: DataFrame, edges: DataFrame, more: list[str], merge: Callable[[list[tuple], dict[int, set]], list[tuple]], schema: str) -> DataFrame:
    """image and what merge makes of an image's region graph: the rows (region, area, L, a, b, more), and the regions beside each. Regions come before edges; graphs are taken image by image as they arrive."""
    none = lambda *names: [F.lit(None).alias(c) for c in names]
    color = ["L", "a", "b"]
    nodes = regions.select(F.col("image").cast("long").alias("image"), F.lit(0).alias("__kind"), F.col("region").cast("long").alias("region"), F.col("area").cast("long").alias("area"), *(F.col(c).cast("double").alias(c) for c in color), *more, F.lit(None).cast("long").alias("__beside"))
    beside = edges.select(F.col("image").cast("long").alias("image"), F.lit(1).alias("__kind"), F.col("a").cast("long").alias("region"), *none("area", *color, *more), F.col("b").cast("long").alias("__beside"))
    kinds = [f.split() for f in schema.split(", ")]
    arrow = {"int": pa.int32(), "boolean": pa.bool_()}

    def work(table: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        image, kind = table["image"].to_pylist(), table["__kind"].to_numpy()
        rows = list(zip(*(table[c].to_pylist() for c in ["region", "area", *color, *more])))
        other = table["__beside"].to_pylist()
        of, found = [], []
        for begin, end in zip(at[:-1].tolist(), at[1:].tolist()):
            split = begin + int((kind[begin:end] == 0).sum())
            near: dict[int, set] = {r[0]: set() for r in rows[begin:split]}
            for i in range(split, end):
                near[rows[i][0]].add(other[i])
                near[other[i]].add(rows[i][0])
            made = merge(rows[begin:split], near) if split > begin else []
            of += [image[begin]] * len(made)
            found += made
        columns = list(zip(*found)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *(pa.array(c, arrow[k]) for c, (_, k) in zip(columns, kinds))], ["image", *(n for n, _ in kinds)])

    return images.in_groups(nodes.unionByName(beside), ["image"], ["__kind", "region", "__beside"], work, f"image long, {schema}")


def absorb_small(regions: DataFrame, edges: DataFrame, least: str, contrast: float = 30.0, passes: int = 20) -> DataFrame:
    """image, region, target, forced, kept: small regions and slivers go into their largest neighbour.

    regions (image, region, area, L, a, b, interior, and `least`: the image's smallest
    area), edges (image, a, b). In each pass the regions under the smallest area or
    without an interior pixel come by ascending area, then id. A sliver merges in
    any case (`forced`); another one only if its colour's mean distance to its
    neighbours is below the contrast, else it is `kept` for good. Colours are means
    by area. Passes go on until nothing moves. An image's region graph is one group.
    """

    def merge(rows: list[tuple], near: dict[int, set]) -> list[tuple]:
        target, forced, kept = _absorbed(
            {r: area for r, area, *_ in rows}, {r: np.array(color, float) for r, _, *color, _, _ in rows}, {r: interior > 0 for r, *_, interior, _ in rows},
            near, int(rows[0][-1]), contrast, passes,
        )

        def last(r: int) -> int:
            while r in target:
                r = target[r]
            return r

        return [(r, last(r), r in forced, r in kept) for r, *_ in rows]

    return _by_graph(regions, edges, ["interior", least], merge, "region int, target int, forced boolean, kept boolean")


def _alike(area: dict, color: dict, near: dict, limit: float, passes: int, kept: set) -> dict:
    """Where each region went: the pairs of a pass are those below the limit at its begin, closest first."""
    target: dict[int, int] = {}

    def last(r: int) -> int:
        while r in target:
            r = target[r]
        return r

    for _ in range(passes):
        pairs = [(a, b) for a in near if a not in kept for b in near[a] if a < b and b not in kept]
        apart = np.linalg.norm(np.array([color[a] for a, _ in pairs]) - np.array([color[b] for _, b in pairs]), axis=1).tolist() if pairs else []
        pairs = sorted((d, a, b) for d, (a, b) in zip(apart, pairs) if d < limit)
        if not pairs:
            break
        for _, a, b in pairs:
            a, b = last(a), last(b)
            if a == b:
                continue
            small, large = sorted((a, b), key=lambda r: (area[r], -r))
            color[large] = (color[large] * area[large] + color[small] * area[small]) / (area[large] + area[small])
            area[large] += area.pop(small)
            for o in near.pop(small):
                near[o].discard(small)
                if o != large:
                    near[o].add(large)
                    near[large].add(o)
            target[small] = large
    return {r: last(r) for r in color}


def merge_alike(regions: DataFrame, edges: DataFrame, limit: float, passes: int = 8) -> DataFrame:
    """image, region, target: neighbouring regions whose colours differ by less than the limit merge, closest first, the smaller into the larger (of equals the larger id into the smaller).

    regions (image, region, area, L, a, b, and `kept` boolean if some are to stay as
    they are), edges (image, a, b). The pairs of a pass are found at its begin; each
    is merged even if colours have moved by then. An image's region graph is one
    group.
    """
    known = regions if "kept" in regions.columns else regions.withColumn("kept", F.lit(False))

    def merge(rows: list[tuple], near: dict[int, set]) -> list[tuple]:
        went = _alike({r: area for r, area, *_ in rows}, {r: np.array(color, float) for r, _, *color, _ in rows}, near, limit, passes, {r for r, *_, kept in rows if kept})
        return [(r, went[r]) for r, *_ in rows]

    return _by_graph(known, edges, ["kept"], merge, "region int, target int")


def region_colors(pixels: DataFrame, channels: list[str], share: float) -> DataFrame:
    """image, region, area, mean of each channel, interior (pixels whose whole surrounding is of the region), least (that share of the image, at least one pixel)."""
    inner = images.interior(pixels)
    stats = inner.groupBy("image", "region").agg(F.count("*").alias("area"), *(F.avg(c).alias(c) for c in channels), F.count_if("interior").alias("interior"))
    whole = stats.groupBy("image").agg(F.greatest(F.lit(1), F.bround(F.sum("area") * share, 0)).cast("long").alias("least"))
    return stats.join(whole, "image")


def _into_neighbours(grid: np.ndarray, least: int, passes: int) -> np.ndarray:
    """Labels of one image; a part takes its new label before the next one is looked at."""
    out, (h, w) = grid.copy(), grid.shape
    flat = out.reshape(-1)
    for _ in range(passes):
        moved = False
        for label in np.unique(out[out >= 0]).tolist():
            parts = np.where(out == label, images.connected((out == label).astype(np.int8)), -1).ravel()
            order = np.argsort(parts, kind="stable")
            order = order[parts[order] >= 0]
            for part in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1):
                if len(part) >= least:
                    continue
                own, ring = set(part.tolist()), set()
                for p in own:
                    y, x = divmod(p, w)
                    ring.update(q * w + r for q in range(max(0, y - 1), min(h, y + 2)) for r in range(max(0, x - 1), min(w, x + 2)))
                beside = Counter(v for v in flat[list(ring - own)].tolist() if v >= 0 and v != label) if len(ring) > len(own) else None
                if beside:
                    flat[part] = max(beside.items(), key=lambda c: (c[1], -c[0]))[0]
                    moved = True
        if not moved:
            break
    return out


def small_parts_merged(pixels: DataFrame, label: str, least: int, passes: int = 3) -> DataFrame:
    """(image, y, x, label) in which connected parts under `least` pixels have the label that most pixels around them have (8 neighbours; ink, below 0, left out; of equals the smaller), label by label in ascending order, for some passes or until nothing moves. What a part becomes depends on the parts before it, so an image's labels are one group."""

    def merge(table: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        ys, xs, labels = (table[c].to_numpy() for c in ("y", "x", label))
        out = np.empty(len(ys), np.int64)
        for a, b in zip(at[:-1], at[1:]):
            y, x = ys[a:b] - ys[a:b].min(), xs[a:b] - xs[a:b].min()
            grid = np.full((y.max() + 1, x.max() + 1), -1, np.int64)
            grid[y, x] = labels[a:b]
            out[a:b] = _into_neighbours(grid, least, passes)[y, x]
        return pa.RecordBatch.from_arrays([table["image"].combine_chunks(), pa.array(ys, pa.int32()), pa.array(xs, pa.int32()), pa.array(out, pa.int32())], ["image", "y", "x", label])

    rows = pixels.select(F.col("image").cast("long").alias("image"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(label).cast("int").alias(label))
    return images.in_groups(rows, ["image"], [], merge, f"image long, y int, x int, {label} int")


# borders


def sides(pixels: DataFrame, label: str) -> DataFrame:
    """image, y0, x0, y1, x1, a, b: every side between two pixels of different labels or at the image's edge, by its corners (pixel (y, x) has the corners y to y + 1, x to x + 1). a is the smaller label, null outside the image."""
    here = F.col(label)
    found = []
    for axis, across in (("x", "y"), ("y", "x")):
        line = Window.partitionBy("image", across).orderBy(axis)
        before, after = F.lag(F.struct(axis, label)).over(line), F.lead(F.struct(axis, label)).over(line)
        met = pixels.select("image", across, axis, here.alias("here"), F.when(before[axis] == F.col(axis) - 1, before[label]).alias("before"), F.when(after[axis] == F.col(axis) + 1, after[label]).alias("after"))
        first = met.filter("before is null or before <> here").select("image", F.col(axis).alias("at"), F.col(across).alias("along"), F.col("before").alias("other"), "here")
        last = met.filter("after is null").select("image", (F.col(axis) + 1).alias("at"), F.col(across).alias("along"), F.col("after").alias("other"), "here")
        both = first.unionByName(last)
        at, along = F.col("at"), F.col("along")
        corners = (along, at, along + 1, at) if axis == "x" else (at, along, at, along + 1)
        low, high = F.when(F.col("other").isNotNull(), F.least("other", "here")), F.greatest("other", "here")
        found.append(both.select("image", *(c.cast("int").alias(n) for c, n in zip(corners, ("y0", "x0", "y1", "x1"), strict=True)), low.alias("a"), high.alias("b")))
    return found[0].unionByName(found[1])


def arcs(border: DataFrame) -> DataFrame:
    """image, arc, a, b, closed, points array<struct<y, x>>: the sides joined into chains between corners where other than two sides meet, each chain once, shared by both labels; rings without such a corner are closed. Chains start at junctions in ascending order, rings at their smallest corner. An image's sides are one group."""

    def walk(found: list[tuple]) -> list[tuple]:
        at: dict[tuple, list] = defaultdict(list)  # corner: (other corner, labels) of its sides
        for y0, x0, y1, x1, a, b in found:
            at[y0, x0].append(((y1, x1), (a, b)))
            at[y1, x1].append(((y0, x0), (a, b)))
        seen, rows = set(), []
        junctions = [c for c in sorted(at) if len(at[c]) != 2]
        stops = set(junctions)
        for start in [*junctions, *sorted(at)]:
            for step, pair in at[start]:
                if frozenset((start, step)) in seen:
                    continue
                points, before, here = [start, step], start, step
                seen.add(frozenset((start, step)))
                while here not in stops and here != start:
                    following = next(n for n, _ in at[here] if n != before)
                    before, here = here, following
                    seen.add(frozenset((before, here)))
                    points.append(here)
                rows.append((len(rows), *pair, here == start and start not in stops, points))
        return rows

    sides = ["y0", "x0", "y1", "x1", "a", "b"]

    def work(table: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        image, rows = table["image"].to_pylist(), list(zip(*(table[c].to_pylist() for c in sides)))
        of, found = [], []
        for begin, end in zip(at[:-1].tolist(), at[1:].tolist()):
            made = walk(rows[begin:end])
            of += [image[begin]] * len(made)
            found += made
        arc, a, b, closed, points = zip(*found)
        corners = np.array([p for line in points for p in line], np.int32)
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, points)]), pa.int32()), pa.StructArray.from_arrays([pa.array(corners[:, 0]), pa.array(corners[:, 1])], ["y", "x"]))
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *(pa.array(c, pa.int32()) for c in (arc, a, b)), pa.array(closed, pa.bool_()), listed], ["image", "arc", "a", "b", "closed", "points"])

    return images.in_groups(border.select("image", *sides), ["image"], sides[:4], work, "image long, arc int, a int, b int, closed boolean, points array<struct<y:int,x:int>>")


def arc_ink(found: DataFrame, pixels: DataFrame, line: str, least: float = INK_ARC) -> DataFrame:
    """image, arc, overlap, ink: the share of an arc's points (as pixels, those at the far edges moved into the image) that are on the line mask, and whether it is at least `least`."""
    sizes = pixels.groupBy("image").agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    points = found.select("image", "arc", F.explode("points").alias("p")).join(sizes, "image").select("image", "arc", F.least("p.y", "my").alias("y"), F.least("p.x", "mx").alias("x")).distinct()
    share = points.join(pixels.select("image", "y", "x", F.col(line).cast("int").alias("on")), ["image", "y", "x"]).groupBy("image", "arc").agg(F.avg("on").alias("overlap"))
    return share.withColumn("ink", F.col("overlap") >= least)
