"""Pixel grids, borders and lines bound to the driver's tables, with SQL where windows or plain joins express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import colors, shapes
from tessella.operators import arrays, grids, images
from tessella.plans.bound import _GRID, _REGION, SQL, bound, gray_images, grid, read

#: The grids with labels 0 to 2, ink (-1) where the value is low.
_INK = f"WITH g AS (SELECT image, y, x, v, CASE WHEN v > 0.1 THEN 2 WHEN v > 0 THEN 1 WHEN v < -0.1 THEN -1 ELSE 0 END AS label FROM ({_GRID}))"


def ink_grid(spark, sf_dir):
    return grid(spark, sf_dir).withColumn("label", F.when(F.col("v") < -0.1, -1).otherwise(F.col("region"))).select("image", "y", "x", "v", "label")


_NEAR = "arg_min({what}, ((a.y - b.y) ** 2 + (a.x - b.x) ** 2) * 10000 + b.y * 100 + b.x)"


@bound(f"""{_INK} SELECT a.image, a.y::INT AS y, a.x::INT AS x, {_NEAR.format(what="b.label")}::INT AS label, CAST(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS BIGINT) AS d2
FROM g a JOIN g b ON a.image = b.image AND b.label >= 0 GROUP BY a.image, a.y, a.x""")
def nearest_fill(spark, sf_dir):
    """Ink pixels take the label of the nearest other pixel."""
    near = grids.nearest(ink_grid(spark, sf_dir), F.col("label") >= 0, "label")
    return near.filter("near is not null").select("image", "y", F.col("x").cast("int").alias("x"), F.col("near.label").alias("label"), "d2")


@bound(f"""{_INK}, d AS (SELECT a.image, a.y, a.x, sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM g a JOIN g b ON a.image = b.image AND a.v <= 0.05 AND b.v > 0.05 GROUP BY ALL),
n AS (SELECT image, count(*) FILTER (v <= 0.05) AS lines FROM g GROUP BY image), m AS (SELECT image, median(d) AS m FROM d GROUP BY image)
SELECT image, CASE WHEN lines = 0 THEN 3.0::DOUBLE ELSE round(2 * m, 6) END AS thickness FROM n LEFT JOIN m USING (image)""")
def line_thickness(spark, sf_dir):
    found = grids.thickness(ink_grid(spark, sf_dir).withColumn("line", F.col("v") <= 0.05), "line")
    return found.select("image", F.round("thickness", 6).alias("thickness"))


@bound(f"""{_INK}, c AS (SELECT image, label, count(*) AS n FROM g WHERE label >= 0 AND (y IN (0, 7) OR x IN (0, 7)) GROUP BY ALL)
SELECT image, arg_max(label, n * 10 - label)::INT AS background FROM c GROUP BY image""")
def background_labels(spark, sf_dir):
    return grids.background_label(ink_grid(spark, sf_dir), "label")


#: Parts by recursion: a pixel's smallest number within its part.
_PARTS = """r AS (SELECT image, y, x, {label} AS label, y * 8 + x AS first FROM g UNION
SELECT b.image, b.y, b.x, b.label, a.first FROM r a JOIN (SELECT image, y, x, {label} AS label FROM g) b ON a.image = b.image AND a.label = b.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
p AS (SELECT image, y, x, label, min(first) AS part FROM r GROUP BY ALL)"""


@bound(f"""{_INK.replace("WITH", "WITH RECURSIVE")}, {_PARTS.format(label="label")}, o AS (SELECT image, part, max(CAST(y IN (0, 7) OR x IN (0, 7) AS INT)) AS open FROM p GROUP BY ALL),
c AS (SELECT image, label, count(*) AS n FROM g WHERE label >= 0 AND (y IN (0, 7) OR x IN (0, 7)) GROUP BY ALL), k AS (SELECT image, arg_max(label, n * 10 - label) AS bg FROM c GROUP BY image),
f AS (SELECT p.*, bg FROM p JOIN o USING (image, part) JOIN k USING (image) WHERE label = bg AND open = 0),
n AS (SELECT a.image, a.y, a.x, {_NEAR.format(what="b.label")} AS label FROM f a JOIN g b ON a.image = b.image AND b.label >= 0 AND b.label <> a.bg GROUP BY a.image, a.y, a.x)
SELECT g.image, g.y::INT AS y, g.x::INT AS x, coalesce(n.label, g.label)::INT AS label FROM g LEFT JOIN n USING (image, y, x)""")
def isolated_background(spark, sf_dir):
    cells = ink_grid(spark, sf_dir).select("image", "y", F.col("x").cast("int").alias("x"), "label")
    return grids.isolated_background(cells, "label")


@bound(f"""{_REGION} , h AS (SELECT image, y, x, region FROM g),
s AS (SELECT a.image, a.y AS y0, a.x + 1 AS x0, a.y + 1 AS y1, a.x + 1 AS x1, a.region AS one, b.region AS two FROM h a LEFT JOIN h b ON b.image = a.image AND b.y = a.y AND b.x = a.x + 1
UNION ALL SELECT image, y, 0, y + 1, 0, region, NULL FROM h WHERE x = 0
UNION ALL SELECT a.image, a.y + 1, a.x, a.y + 1, a.x + 1, a.region, b.region FROM h a LEFT JOIN h b ON b.image = a.image AND b.y = a.y + 1 AND b.x = a.x
UNION ALL SELECT image, 0, x, 0, x + 1, region, NULL FROM h WHERE y = 0)
SELECT image, y0::INT AS y0, x0::INT AS x0, y1::INT AS y1, x1::INT AS x1, CASE WHEN two IS NOT NULL THEN least(one, two) END::INT AS a, greatest(one, coalesce(two, one))::INT AS b FROM s WHERE two IS NULL OR one <> two""")
def border_sides(spark, sf_dir):
    return grids.sides(grid(spark, sf_dir), "region")


@bound()
def border_arcs(spark, sf_dir):
    """Arcs of each image, their length and whether they lie on dark pixels."""
    cells = grid(spark, sf_dir)
    found = grids.arcs(grids.sides(cells, "region"))
    ink = grids.arc_ink(found, images.line_mask(cells, "v", -0.05), "line")
    return found.join(ink, ["image", "arc"]).select("image", "arc", "a", "b", "closed", (F.size("points") - 1).alias("sides"), F.round("overlap", 6).alias("overlap"), "ink")


@bound("""SELECT p_partkey, '#' || upper(printf('%02x%02x%02x', p_partkey % 256, p_partkey * 7 % 256, p_partkey * 13 % 256)) AS hex FROM part""")
def lab_hexes(spark, sf_dir):
    """Colours to Lab and back as text; a half is added, as channels are cut down."""
    k = F.col("p_partkey")
    lab = colors.rgb_to_lab(k % 256, (k * 7) % 256, (k * 13) % 256)
    lighter = F.transform(F.array(lab), lambda c: F.named_struct(F.lit("L"), c["L"] + 0.02, F.lit("a"), c["a"], F.lit("b"), c["b"]))[0]
    return read(spark, sf_dir, "part").select("p_partkey", colors.lab_hex(lighter).alias("hex"))


@bound()
def absorbed_regions(spark, sf_dir):
    """Connected parts of the grids as regions; the small ones and slivers go into their neighbours."""
    parts = images.components(grid(spark, sf_dir)).select("image", "y", "x", F.col("part").cast("int").alias("region"))
    cells = parts.join(grid(spark, sf_dir).select("image", "y", F.col("x").cast("int").alias("x"), (F.col("v") * 100).alias("L"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), ["image", "y", "x"])
    regions = grids.region_colors(cells, ["L", "a", "b"], 0.05)
    return grids.absorb_small(regions, arrays.adjacency(cells), "least", 12.0)


@bound()
def image_palettes(spark, sf_dir):
    """Three grey levels for each image, by k-means of its pixels that are not ink."""
    cells = ink_grid(spark, sf_dir).filter("label >= 0").withColumn("L", F.round(F.col("v") * 255, 0))
    found = grids.palettes(cells, ["image"], ["L"], 3)
    return grids.assigned(cells, found, ["image"], ["L"]).groupBy("image", "cluster").agg(F.count("*").alias("n"), F.round(F.avg("L"), 4).alias("mean"))


@bound()
def small_parts_merged(spark, sf_dir):
    cells = ink_grid(spark, sf_dir)
    return grids.small_parts_merged(cells, "label", 4).groupBy("image", "label").agg(F.count("*").alias("n"))


#: SQL of queries whose parts a recursion finds.
SQL["image_components"] = f"{_REGION.replace('WITH', 'WITH RECURSIVE')}, {_PARTS.format(label='region')} SELECT image, count(DISTINCT part) AS parts FROM p GROUP BY image"
SQL["image_openness"] = f"""WITH RECURSIVE g AS (SELECT image, y, x, CAST(greatest(0, least(255, CAST(trunc(128 + v * 600) AS INT))) >= 128 AS INT) AS white FROM ({_GRID})), {_PARTS.format(label="white")},
o AS (SELECT image, part, max(CAST(y IN (0, 7) OR x IN (0, 7) AS INT)) AS open FROM p GROUP BY ALL)
SELECT image AS vec_id, CASE WHEN sum(label) = 0 THEN 0.0::DOUBLE ELSE round(CAST(sum(label * open) AS DOUBLE) / sum(label), 6) END AS openness FROM p JOIN o USING (image, part) GROUP BY image"""


@bound()
def silhouettes(spark, sf_dir):
    cells = grid(spark, sf_dir).withColumn("x", F.col("x").cast("int"))
    return grids.silhouettes(cells, ["v"]).groupBy("image").agg(F.sum("inside").alias("inside"))


@bound()
def simplified_tracks(spark, sf_dir):
    """The course of each user's values over their events, without the points that no change of over a tenth of the value range shows."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    line = F.transform("e", lambda r, i: F.struct(i.cast("double").alias("x"), r["value"].alias("y")))
    return e.select("user_id", F.size("e").alias("points"), shapes.simplified(line, 10.0).alias("kept")).select("user_id", "points", F.size("kept").alias("kept"))


@bound()
def diffused_images(spark, sf_dir):
    g = gray_images(spark, sf_dir)
    done = images.diffuse(F.lit(8), F.lit(8), F.col("gray"))
    return g.select("vec_id", F.array_join(F.transform(done, lambda v: F.when(v > 0, "1").otherwise("0")), "").alias("pixels"))


@bound()
def stippled_images(spark, sf_dir):
    g = gray_images(spark, sf_dir)
    return g.select("vec_id", F.size(images.stipple(F.lit(8), F.lit(8), F.col("gray"), 2.0, F.col("vec_id"))).alias("points"))


@bound(f"""WITH g AS (SELECT image, y, x, greatest(0, least(255, CAST(trunc(128 + v * 600) AS INT))) AS gray FROM ({_GRID})), c AS (SELECT image, y // 4 AS cy, x // 4 AS cx, avg(gray) AS m FROM g GROUP BY ALL),
r AS (SELECT image, cy, cx, (255 - m) / 255 * 1.9::DOUBLE AS r FROM c)
SELECT g.image, count(*) FILTER (r >= 0.5 AND (y - cy * 4 - 2) ** 2 + (x - cx * 4 - 2) ** 2 <= r * r) AS black FROM g JOIN r ON r.image = g.image AND cy = y // 4 AND cx = x // 4 GROUP BY g.image""")
def halftones(spark, sf_dir):
    g = gray_images(spark, sf_dir).select(F.col("vec_id").alias("image"), F.posexplode("gray").alias("p", "gray"))
    cells = g.select("image", F.floor(F.col("p") / 8).alias("y"), (F.col("p") % 8).alias("x"), "gray")
    return images.halftone(cells, "gray", 4).groupBy("image").agg(F.count_if(F.col("dot") == 0).alias("black"))


_GRAY = f"""WITH g AS (SELECT image, y, x, greatest(0, least(255, CAST(trunc(128 + v * 600) AS INT))) AS gray FROM ({_GRID})),
b AS (SELECT *, gray BETWEEN 80 AND 200 AS grey, CASE WHEN gray < 80 THEN 0 ELSE 255 END AS base, y // 4 AS cy, x // 4 AS cx FROM g), c AS (SELECT image, cy, cx, avg(gray) FILTER (grey) AS m FROM b GROUP BY ALL),
d AS (SELECT b.*, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (200 - m) / 120)) AS dark, (y - cy * 4 - 2) ** 2 + (x - cx * 4 - 2) ** 2 AS r2 FROM b JOIN c USING (image, cy, cx))"""


@bound(f"""{_GRAY}, e AS (SELECT image, CASE WHEN grey AND (x + y) % greatest(2, CAST(round_even(8 - 6 * dark, 0) AS INT)) = 0 THEN 0 ELSE base END AS hatching, CASE WHEN dark * 1.9 >= 0.5 AND r2 <= (dark * 1.9) ** 2 THEN 0 ELSE base END AS dots,
CASE WHEN grey AND CAST('0x' || md5('42:' || image || ':' || y || ':' || x)[1:8] AS BIGINT) / 4294967296.0::DOUBLE < (200 - gray) / 120.0::DOUBLE THEN 0 ELSE base END AS stippling FROM d)
SELECT image, count(*) FILTER (hatching = 0) AS hatching, count(*) FILTER (dots = 0) AS dots, count(*) FILTER (stippling = 0) AS stippling FROM e GROUP BY image""")
def grays_replaced(spark, sf_dir):
    """Black pixels of each image after each way of replacing grey."""
    g = gray_images(spark, sf_dir).select(F.col("vec_id").alias("image"), F.posexplode("gray").alias("p", "gray"))
    cells = g.select("image", F.floor(F.col("p") / 8).alias("y"), (F.col("p") % 8).alias("x"), "gray")
    for how in ("hatching", "dots", "stippling"):
        cells = images.gray_replaced(cells, "gray", how, cell=4).withColumnRenamed("out", how)
    return cells.groupBy("image").agg(*(F.count_if(F.col(how) == 0).alias(how) for how in ("hatching", "dots", "stippling")))


@bound()
def alike_regions(spark, sf_dir):
    """Connected parts of the grids; neighbours of like grey merge."""
    parts = images.components(grid(spark, sf_dir)).select("image", "y", "x", F.col("part").cast("int").alias("region"))
    cells = parts.join(grid(spark, sf_dir).select("image", "y", F.col("x").cast("int").alias("x"), (F.col("v") * 100).alias("L"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), ["image", "y", "x"])
    return grids.merge_alike(grids.region_colors(cells, ["L", "a", "b"], 0.05), arrays.adjacency(cells), 6.0)
