"""Grids, borders, palettes and lines against plain versions on small random images."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import colors, shapes
from tessella.operators import arrays, grids, images, lookups
from tessella.plans import shapes as queries

SEEDS = range(4)


def table(spark, grid_of, columns="image long, y int, x int, label int"):
    return spark.createDataFrame([(i, y, x, *(v if isinstance(v, tuple) else (v,))) for i, g in grid_of.items() for (y, x), v in g.items()], columns)


def random_grid(seed, h=7, w=9, labels=(-1, 0, 1, 2)):
    rng = random.Random(seed)
    return {(y, x): rng.choice(labels) for y in range(h) for x in range(w)}


def flood(g, cells):
    """Connected sets of equal label among the cells."""
    left, out = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if n in left and g[n] == g[y, x]:
                    left.discard(n)
                    todo.append(n)
        out.append(part)
    return out


def closest(g, at, ok):
    return min(((p[0] - at[0]) ** 2 + (p[1] - at[1]) ** 2, p) for p in g if ok(g[p]))


@pytest.mark.parametrize("seed", range(30))
def test_lower_envelope_against_all_pairs(seed):
    rng = random.Random(seed)
    ys = sorted(rng.sample(range(40), rng.randint(1, 20)))
    cost = [None if rng.random() < 0.3 else rng.randint(0, 60) for _ in ys]
    plain = [min(((c + (y - ys[k]) ** 2, k) for k, c in enumerate(cost) if c is not None), default=(0, None))[1] for y in ys]
    assert grids.lower_envelope(ys, cost) == plain


def test_nearest_against_all_pairs(spark):
    g = {s: random_grid(s) for s in SEEDS} | {9: {(y, x): -1 for y in range(3) for x in range(3)}}
    found = {(r.image, r.y, r.x): r for r in grids.nearest(table(spark, g), F.col("label") >= 1, "label").collect()}
    assert len(found) == sum(map(len, g.values()))
    for i, cells in g.items():
        for at in cells:
            r = found[i, *at]
            if i == 9:
                assert r.near is None and r.d2 is None
            else:
                d2, p = closest(cells, at, lambda v: v >= 1)
                assert (r.d2, r.near.y, r.near.x, r.near.label) == (d2, *p, cells[p])
    near = grids.filled(table(spark, g), "label", F.col("label") < 0, limit=1.0).collect()
    for r in near:
        before = g[r.image][r.y, r.x]
        if before >= 0 or r.image == 9:
            assert r.label == before
        else:
            d2, p = closest(g[r.image], (r.y, r.x), lambda v: v >= 0)
            assert r.label == (g[r.image][p] if d2 <= 1 else before)


def test_thickness(spark):
    g = {s: random_grid(s, labels=(0, 1)) for s in SEEDS} | {7: {(0, 0): 0, (0, 1): 0}, 8: {(0, 0): 1}}
    rows = table(spark, g).withColumn("line", F.col("label") == 1)
    found = dict(map(tuple, grids.thickness(rows, "line").collect()))
    assert found[7] == grids.NO_LINE and found[8] is None
    for s in SEEDS:
        assert found[s] == pytest.approx(2 * np.median([math.sqrt(closest(g[s], p, lambda v: v == 0)[0]) for p, v in g[s].items() if v == 1]))


def edge(cells, p):
    return p[0] in (0, max(y for y, _ in cells)) or p[1] in (0, max(x for _, x in cells))


def test_isolated_background_against_flood(spark):
    g = {s: random_grid(s, labels=(-1, 0, 0, 0, 1)) for s in range(8)}
    found = {(r.image, r.y, r.x): r.label for r in grids.isolated_background(table(spark, g), "label").collect()}
    labels = dict(map(tuple, grids.background_label(table(spark, g), "label").collect()))
    for i, cells in g.items():
        border = [v for p, v in cells.items() if edge(cells, p) and v >= 0]
        background = min(set(border), key=lambda v: (-border.count(v), v))
        assert labels[i] == background
        plain = dict(cells)
        for part in flood(cells, cells):
            if cells[min(part)] == background and not any(edge(cells, p) for p in part):
                for p in part:
                    plain[p] = cells[closest(cells, p, lambda v: v >= 0 and v != background)[1]]
        assert {p: found[i, *p] for p in cells} == plain


def test_holes_and_largest_part(spark):
    g = {s: random_grid(s, labels=(0, 1, 1)) for s in SEEDS}
    whole = {(r.image, r.y, r.x): r.label for r in grids.without_holes(table(spark, g), "label").collect()}
    largest = {(r.image, r.y, r.x): r.label for r in grids.largest_part(table(spark, g), "label").collect()}
    for i, cells in g.items():
        parts = flood(cells, cells)
        holes = set().union(*(p for p in parts if cells[min(p)] == 0 and not any(edge(cells, q) for q in p)))
        assert all(whole[i, *p] == (1 if p in holes else v) for p, v in cells.items())
        kept = max((p for p in parts if cells[min(p)] == 1), key=lambda p: (len(p), [-v for v in min(p)]))
        assert {p for p in cells if largest[i, *p]} == kept


def test_silhouette_of_a_ring(spark):
    cells = {(y, x): (200.0 if 3 <= y <= 11 and 3 <= x <= 11 and not (6 <= y <= 8 and 6 <= x <= 8) else 10.0 + (y + x) % 3) for y, x in product(range(15), range(15))}
    rows = table(spark, {1: cells}, "image long, y int, x int, v double")
    inside = {(r.y, r.x) for r in grids.silhouettes(rows, ["v"]).collect() if r.inside}
    assert inside == {(y, x) for y, x in cells if 3 <= y <= 11 and 3 <= x <= 11}


def plain_kmeans(points, k, seed, rounds=100):
    rng = random.Random(seed)
    centers = rng.sample(sorted(set(points)), k)
    for _ in range(rounds):
        groups = [[] for _ in centers]
        for p in points:
            groups[min(range(k), key=lambda c: math.dist(p, centers[c]))].append(p)
        centers = [tuple(np.mean(g, axis=0)) if g else c for g, c in zip(groups, centers)]
    return sum(min(math.dist(p, c) for c in centers) ** 2 for p in points)


def test_palettes_are_good_and_repeatable(spark):
    rng = random.Random(5)
    rows = [(i, float(rng.choice((0, 50, 90)) + rng.randint(0, 4)), float(rng.choice((0, 80)) + rng.randint(0, 4))) for i in (1, 2) for _ in range(150)] + [(3, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "image long, a double, b double")
    found = {r.image: r for r in grids.palettes(df, ["image"], ["a", "b"], 6).collect()}
    again = {r.image: r for r in grids.palettes(df.repartition(7), ["image"], ["a", "b"], 6).collect()}
    assert found == again and found[3].centers == [[1.0, 1.0]]
    for i in (1, 2):
        points = [(a, b) for j, a, b in rows if j == i]
        assert found[i].inertia <= 1.001 * min(plain_kmeans(points, 6, s) for s in range(8))
    near = grids.assigned(df, grids.palettes(df, ["image"], ["a", "b"], 6), ["image"], ["a", "b"]).collect()
    assert all(r.cluster == min(range(len(found[r.image].centers)), key=lambda c: math.dist((r.a, r.b), found[r.image].centers[c])) for r in near)


def test_split_of_mixed_parts(spark):
    """Two colours in one part are cut, a part of one colour is not, nor one with a single large piece."""
    cells = [(1, 10, y, x, 0.0 if x < 8 else 90.0) for y, x in product(range(10), range(16))]
    cells += [(1, 11, 20 + y, x, 50.0) for y, x in product(range(10), range(10))]
    cells += [(1, 12, 40 + y, x, 90.0 if y == 0 and x < 9 else 0.0) for y, x in product(range(3), range(20))]
    df = spark.createDataFrame(cells, "image long, part long, y int, x int, L double")
    pieces = {}
    for r in grids.split_mixed(df, ["L"], k=2).collect():
        pieces.setdefault((r.part, r.piece), set()).add((r.y, r.x))
    assert len([k for k in pieces if k[0] == 10]) == 2 and all(len(v) == 80 for k, v in pieces.items() if k[0] == 10)
    assert [k for k in pieces if k[0] != 10] == [(11, None), (12, None)] or {k for k in pieces if k[0] != 10} == {(11, None), (12, None)}


def plain_absorb(cells, color, least, contrast, passes=20):
    """The same rule, with areas, neighbours and colours found anew from the pixels at every step."""
    cells, kept, forced = dict(cells), set(), set()
    sliver = {}
    for r in set(cells.values()):
        around = lambda p: [(p[0] + dy, p[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (p[0] + dy, p[1] + dx) in cells]
        sliver[r] = not any(v == r and all(cells[q] == r for q in around(p)) for p, v in cells.items())
    area = lambda r: sum(v == r for v in cells.values())
    mean = lambda r: np.mean([color[p] for p, v in cells.items() if v == r], axis=0)
    near = lambda r: {cells[q] for (y, x), v in cells.items() if v == r for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)) if q in cells} - {r}
    for _ in range(passes):
        moved = False
        for _, r in sorted((area(r), r) for r in set(cells.values()) if r not in kept and (area(r) < least or sliver[r])):
            if r not in cells.values() or not near(r) or (area(r) >= least and not sliver[r]):
                continue
            if sliver[r]:
                forced.add(r)
            elif np.mean([np.linalg.norm(mean(r) - mean(o)) for o in near(r)]) >= contrast:
                kept.add(r)
                continue
            into = max(near(r), key=lambda o: (area(o), -o))
            cells = {p: into if v == r else v for p, v in cells.items()}
            moved = True
        if not moved:
            return cells, kept, forced
    return cells, kept, forced


@pytest.mark.parametrize("share", [0.02, 0.12])
def test_absorbed_regions_against_plain_version(spark, share):
    rng = random.Random(3)
    rows, plain = [], {}
    for i in range(5):
        low = random_grid(100 + i, 5, 6, (1, 2, 3, 4))
        cells = {(y, x): low[y // 4, x // 4] for y, x in product(range(20), range(24))}
        for _ in range(25):  # specks and slivers
            cells[rng.randrange(20), rng.randrange(24)] = 5
        parts = {p: min(q[0] * 24 + q[1] for q in part) for part in flood(cells, cells) for p in part}
        color = {p: (40.0 * cells[p] + rng.random(), rng.random(), 0.0) for p in cells}
        rows += [(i, *p, parts[p], *color[p]) for p in cells]
        plain[i] = parts, *plain_absorb(parts, color, max(1, round(share * 480)), 45.0)
    df = spark.createDataFrame(rows, "image long, y int, x int, region int, L double, a double, b double")
    regions = grids.region_colors(df, ["L", "a", "b"], share)
    found = grids.absorb_small(regions, arrays.adjacency(df), "least", 45.0).collect()
    for i, (parts, cells, kept, forced) in plain.items():
        own = {r.region: r for r in found if r.image == i}
        assert {p: own[v].target for p, v in parts.items()} == cells
        assert {r for r in own if own[r].kept} == kept and {r for r in own if own[r].forced} == forced


def test_sides_and_arcs(spark):
    g = {s: random_grid(s, 6, 6, (0, 1, 2)) for s in SEEDS} | {8: {(y, x): int(2 <= y <= 3 and 2 <= x <= 3) for y, x in product(range(6), range(6))}, 9: {(0, 0): 5}}
    border = grids.sides(table(spark, g), "label")
    sides = {}
    for r in border.collect():
        assert sides.setdefault((r.image, (r.y0, r.x0), (r.y1, r.x1)), (r.a, r.b)) == (r.a, r.b)
    plain = {}
    for i, cells in g.items():
        for y, x in cells:
            for n, corners in (((y - 1, x), ((y, x), (y, x + 1))), ((y + 1, x), ((y + 1, x), (y + 1, x + 1))), ((y, x - 1), ((y, x), (y + 1, x))), ((y, x + 1), ((y, x + 1), (y + 1, x + 1)))):
                other = cells.get(n)
                if other != cells[y, x]:
                    plain[i, *corners] = (None if other is None else min(other, cells[y, x]), cells[y, x] if other is None else max(other, cells[y, x]))
    assert sides == plain and border.count() == len(plain)
    meeting = {}
    for i, p, q in plain:
        meeting[i, p] = meeting.get((i, p), 0) + 1
        meeting[i, q] = meeting.get((i, q), 0) + 1
    seen = {}
    for r in grids.arcs(border).collect():
        points = [(p.y, p.x) for p in r.points]
        for p, q in zip(points, points[1:]):
            key = (r.image, *sorted((p, q)))
            assert key not in seen and plain[key] == (r.a, r.b)
            seen[key] = r.arc
        assert all(meeting[r.image, p] == 2 for p in points[1:-1])
        assert r.closed == (points[0] == points[-1] and meeting[r.image, points[0]] == 2)
        if not r.closed:
            assert meeting[r.image, points[0]] != 2 and meeting[r.image, points[-1]] != 2
    assert len(seen) == len(plain)
    assert sum(r.closed for r in grids.arcs(border.filter("image = 8")).collect()) == 2


def test_arc_ink(spark):
    cells = {(y, x): (0 if x < 3 else 1, int(x == 3 and y < 3)) for y, x in product(range(6), range(6))}
    df = table(spark, {1: cells}, "image long, y int, x int, label int, line int")
    found = grids.arcs(grids.sides(df, "label"))
    ink = {r.arc: r for r in grids.arc_ink(found, df.withColumn("line", F.col("line") == 1), "line").collect()}
    (between,) = [r.arc for r in found.collect() if r.a == 0]
    assert ink[between].overlap == pytest.approx(3 / 6) and not ink[between].ink


def distance_to_line(p, line):
    best = math.inf
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        d2 = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if not d2 else max(0, min(1, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / d2))
        best = min(best, math.dist(p, (ax + t * (bx - ax), ay + t * (by - ay))))
    return best


def plain_simplified(points, tolerance):
    if len(points) < 3:
        return points
    far = [distance_to_line(p, [points[0], points[-1]]) for p in points[1:-1]]
    k = far.index(max(far)) + 1
    if far[k - 1] <= tolerance:
        return [points[0], points[-1]]
    return plain_simplified(points[: k + 1], tolerance)[:-1] + plain_simplified(points[k:], tolerance)


def test_simplified_lines(spark):
    rng = random.Random(4)
    lines = [[(float(i), rng.uniform(-3, 3)) for i in range(rng.randint(0, 40))] for _ in range(20)] + [None, [(0.0, 0.0)] * 5, [(0.0, 0.0), (2.0, 2.0), (4.0, 0.0), (0.0, 0.0)]]
    df = spark.createDataFrame([(k, p and [dict(zip("xy", q)) for q in p]) for k, p in enumerate(lines)], "k int, p array<struct<x:double,y:double>>")
    for r in df.select("k", shapes.simplified(F.col("p"), 1.0).alias("s")).collect():
        found = None if r.s is None else [tuple(q) for q in r.s]
        assert found == (lines[r.k] if lines[r.k] is None else plain_simplified(lines[r.k], 1.0))
        if found and len(found) > 1:
            assert all(distance_to_line(p, found) <= 1.0 + 1e-9 for p in lines[r.k])


def test_long_lines_have_no_limit(spark):
    n = 1_200_000
    line = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct(i.cast("double").alias("x"), F.when(i == n // 2, 9.0).otherwise(0.0).alias("y"))).alias("p"))
    got = line.select(F.size(shapes.simplified(F.col("p"), 0.5)).alias("kept"), colors.polygon_area(F.col("p")).alias("area"), F.size(colors.chaikin(F.col("p"))).alias("cut")).first()
    assert got.kept == 5 and got.area == pytest.approx(-9.0) and got.cut == 2 * (n + 1)


def test_open_chaikin_and_edges(spark):
    points = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((10, 10), (14, 10), (14, 14))))
    at = lambda c: [tuple(p) for p in spark.range(1).select(c).first()[0]]
    assert at(shapes.chaikin_open(points)) == [(10, 10), (11, 10), (13, 10), (14, 11), (14, 13), (14, 14)]
    assert len(at(shapes.smoothed(points, F.lit(30), F.lit(30), 0.5))) == 6
    assert len(at(shapes.smoothed(points, F.lit(16), F.lit(30), 0.5))) == 3


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (13, 17)])
def test_error_diffusion_is_sequential(shape):
    rng = np.random.default_rng(shape[0])
    gray = rng.integers(0, 256, shape).astype(float)
    a, (h, w) = gray.copy(), shape
    for y, x in product(range(h), range(w)):
        new = 255.0 if a[y, x] >= 128 else 0.0
        error, a[y, x] = a[y, x] - new, new
        for dy, dx, s in images.DIFFUSED:
            if y + dy < h and 0 <= x + dx < w:
                a[y + dy, x + dx] += error * s
    assert (images.diffused(gray) == a).all()


def test_error_diffusion_keeps_the_mean(spark):
    gray = [(k, [int(v) for v in np.clip(np.random.default_rng(k).normal(40 * k + 40, 30, 64 * 64), 0, 255)]) for k in range(5)]
    df = spark.createDataFrame(gray, "k int, gray array<int>")
    for r in df.select("k", images.diffuse(F.lit(64), F.lit(64), F.col("gray")).alias("d")).collect():
        assert abs(np.mean(r.d) - np.mean(gray[r.k][1])) < 255 / 64  # what leaves at the edges


def test_stipples_keep_their_distance(spark):
    gray = [int(v) for v in np.linspace(0, 255, 40 * 40)]
    df = spark.createDataFrame([(s, gray) for s in (1, 1, 2)], "seed long, gray array<int>")
    found = [(r.seed, [tuple(p) for p in r.p]) for r in df.select("seed", images.stipple(F.lit(40), F.lit(40), F.col("gray"), 3.0, F.col("seed")).alias("p")).collect()]
    a, b, c = (p for _, p in sorted(found))
    assert a == b != c
    assert all(math.dist(p, q) >= 3 for i, p in enumerate(a) for q in a[:i])
    assert all(any(math.dist(p, q) < 3 for q in a) for p in product(range(40), range(40)) if gray[p[0] * 40 + p[1]] < 255)


def test_first_contained_in_long_documents(spark, monkeypatch):
    """Whole texts against 10,000 names, by the automaton and by the join."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy(F.desc(F.length("text")), "doc_id").limit(20)
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "", -3: "éxé"}
    rng = random.Random(1)
    whole = " ".join(t for t in texts.values() if t)
    names = {whole[a : a + rng.randint(1, 9)] for a in rng.choices(range(len(whole) - 9), k=40)} | {f"name {k}" for k in range(10_000)} | {"", "é"}
    ranked = [(n, rng.randint(0, 5000)) for n in sorted(names)]
    plain = {i: min(((r, n) for n, r in ranked if n and t and n in t), default=(0, None))[1] for i, t in texts.items()}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame(ranked, "name string, rank int")
    assert dict(map(tuple, lookups.first_contained(rows, "text", table, "name", "rank").select("doc_id", "match").collect())) == plain
    monkeypatch.setattr(lookups, "AUTOMATON_NAMES", 10)
    few = {i: t for i, t in texts.items() if i < 0} | dict(sorted((i, t[:20_000]) for i, t in texts.items() if t)[:3])
    rows = spark.createDataFrame(list(few.items()), "doc_id long, text string")
    plain = {i: min(((r, n) for n, r in ranked if n and t and n in t), default=(0, None))[1] for i, t in few.items()}
    assert dict(map(tuple, lookups.first_contained(rows, "text", table, "name", "rank").select("doc_id", "match").collect())) == plain
    assert lookups.first_contained(rows, "text", table.limit(0), "name", "rank").filter("match is not null").isEmpty()


def plain_alike(cells, color, limit, kept=(), passes=8):
    """The same rule, with areas and colours found anew from the pixels."""
    cells = dict(cells)
    for _ in range(passes):
        area = lambda r: sum(v == r for v in cells.values())
        mean = {r: np.mean([color[p] for p, v in cells.items() if v == r], axis=0) for r in set(cells.values())}
        beside = {tuple(sorted((v, cells[q]))) for (y, x), v in cells.items() for q in ((y + 1, x), (y, x + 1)) if q in cells and cells[q] != v}
        pairs = sorted((float(np.linalg.norm(mean[a] - mean[b])), a, b) for a, b in beside if a not in kept and b not in kept)
        pairs = [p for p in pairs if p[0] < limit]
        went = {r: r for r in mean}
        for _, a, b in pairs:
            a, b = went[a], went[b]
            if a != b:
                small, large = sorted((a, b), key=lambda r: (area(r), -r))
                cells = {p: large if v == small else v for p, v in cells.items()}
                went = {r: large if t == small else t for r, t in went.items()}
        if not pairs:
            break
    return cells


@pytest.mark.parametrize("limit", [3.0, 12.0])
def test_alike_regions_against_plain_version(spark, limit):
    rng = random.Random(8)
    rows, plain, kept = [], {}, {}
    for i in range(6):
        cells = random_grid(200 + i, 7, 8, (1, 2, 3))
        parts = {p: min(q[0] * 8 + q[1] for q in part) for part in flood(cells, cells) for p in part}
        color = {p: (10.0 * cells[p] + rng.randint(0, 6), float(rng.randint(0, 3)), 0.0) for p in cells}
        kept[i] = set(rng.sample(sorted(set(parts.values())), 3))
        rows += [(i, *p, parts[p], *color[p]) for p in cells]
        plain[i] = parts, plain_alike(parts, color, limit, kept[i])
    df = spark.createDataFrame(rows, "image long, y int, x int, region int, L double, a double, b double")
    marked = spark.createDataFrame([(i, r, True) for i, rs in kept.items() for r in rs], "image long, region int, kept boolean")
    regions = grids.region_colors(df, ["L", "a", "b"], 0.1).join(marked, ["image", "region"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    found = grids.merge_alike(regions, arrays.adjacency(df), limit).collect()
    for i, (parts, cells) in plain.items():
        target = {r.region: r.target for r in found if r.image == i}
        assert {p: target[v] for p, v in parts.items()} == cells


def test_gray_replacement(spark):
    cells = {(y, x): (10 if x == 0 else 250 if x == 1 else 80 if x < 8 else 190) for y, x in product(range(16), range(16))}
    df = table(spark, {1: cells})
    got = {how: {(r.y, r.x): r.out for r in images.gray_replaced(df, "label", how).collect()} for how in ("white", "dots", "hatching", "stippling")}
    for out in got.values():
        assert all(out[y, 0] == 0 for y in range(16)) or out is got["dots"]
    assert all(v == 255 for (y, x), v in got["white"].items() if x) and all(got[how][y, 1] == 255 for how in ("hatching", "stippling") for y in range(16))
    dark, pale = (lambda how: sum(got[how][y, x] == 0 for y in range(16) for x in range(2, 8))), (lambda how: sum(got[how][y, x] == 0 for y in range(16) for x in range(8, 16)))
    assert all(dark(how) > pale(how) for how in ("dots", "hatching", "stippling")) and dark("stippling") == 96
    with pytest.raises(ValueError, match="no way"):
        images.gray_replaced(df, "label", "waves")


def plain_small_parts(cells, least, passes=3):
    cells = dict(cells)
    for _ in range(passes):
        moved = False
        for label in sorted({v for v in cells.values() if v >= 0}):
            for part in sorted(flood(cells, [p for p, v in cells.items() if v == label]), key=min):
                if len(part) >= least:
                    continue
                ring = {(y + dy, x + dx) for y, x in part for dy in (-1, 0, 1) for dx in (-1, 0, 1)} - part
                beside = [cells[p] for p in ring if p in cells and cells[p] >= 0 and cells[p] != label]
                if beside:
                    new = min(set(beside), key=lambda v: (-beside.count(v), v))
                    cells |= dict.fromkeys(part, new)
                    moved = True
        if not moved:
            break
    return cells


@pytest.mark.parametrize("least", [1, 4, 100])
def test_small_parts_against_plain_version(spark, least):
    g = {s: random_grid(s, 8, 9, (-1, 0, 1, 2, 3)) for s in range(6)}
    found = {(r.image, r.y, r.x): r.label for r in grids.small_parts_merged(table(spark, g), "label", least).collect()}
    for i, cells in g.items():
        assert {p: found[i, *p] for p in cells} == plain_small_parts(cells, least)


def test_marks_of_leaves(spark):
    from tessella.functions import templates

    rows = spark.createDataFrame([("Three_bears", "n"), ("threesome", "n"), ("cat_and_dog", "n"), ("duck_with_chicks", None), (None, "n")], "leaf string, neg string")
    got = [tuple(r) for r in rows.select(templates.numbered(F.col("leaf")), templates.several(F.col("leaf")), templates.isolated(F.col("neg"), F.col("leaf"))).collect()]
    assert got == [(True, False, "n"), (False, False, "n"), (False, True, "n" + templates.ISOLATION), (False, True, None), (False, False, "n")]
    assert spark.range(1).select(colors.lab_hex(colors.rgb_to_lab(F.lit(255), F.lit(255), F.lit(255)))).first()[0] in ("#FFFFFF", "#FEFEFE")


def test_queries_without_sql(spark, sf_dir):
    arcs = queries.border_arcs(spark, sf_dir).collect()
    assert sum(r.sides for r in arcs) == queries.border_sides(spark, sf_dir).count()
    assert all(r.kept <= r.points and r.kept >= min(2, r.points) for r in queries.simplified_tracks(spark, sf_dir).collect())
    assert queries.image_palettes(spark, sf_dir).groupBy("image").agg(F.sum("n").alias("n")).filter("n > 64").isEmpty()
    white = {r.vec_id: r.pixels.count("1") for r in queries.diffused_images(spark, sf_dir).collect()}
    gray = {r.vec_id: sum(r.gray) for r in queries.gray_images(spark, sf_dir).collect()}
    assert all(abs(255 * n - gray[k]) < 255 * 9 for k, n in white.items())
    merged = queries.absorbed_regions(spark, sf_dir)
    assert merged.filter("forced and region = target").isEmpty() and not merged.isEmpty()
    for name in ("silhouettes", "stippled_images"):
        assert getattr(queries, name)(spark, sf_dir).count() == len(gray)
