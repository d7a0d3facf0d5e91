"""Numbers within groups of any size, orders of trees, and the small column functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import colors, text
from tessella.operators import arrays, lookups, ranges, summaries, trees
from tessella.sources import readers


def test_row_numbers_of_a_hot_group(spark):
    """Nine rows in ten belong to one group; its ranges are numbered apart."""
    rng = random.Random(2)
    rows = [("hot" if k % 10 else f"g{k % 7}", rng.randrange(10**9)) for k in range(4000)] + [(None, 5), (None, None)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = ranges.row_numbers(df, ["g"], ["v"], "r").collect()
    for g in {r[0] for r in rows} - {None}:
        assert [r.v for r in sorted((r for r in got if r.g == g), key=lambda r: r.r)] == sorted(v for h, v in rows if h == g)
        assert sorted(r.r for r in got if r.g == g) == list(range(1, 1 + sum(h == g for h, _ in rows)))
    spread = ranges.in_ranges(df, ["g"], ["v"]).groupBy("g").agg(F.countDistinct("__range").alias("n")).filter("g = 'hot'").first().n
    assert spread > 1


def test_order_statistics_of_a_hot_group(spark):
    rng = random.Random(3)
    values = {"hot": [rng.randrange(10**6) for _ in range(3000)], "one": [4]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v long")
    n = F.col("n")
    got = {r.g: r for r in summaries.order_statistics(df, "g", "v", low=F.lit(0), third=F.floor(n / 3), last=n - 1, none=n).collect()}
    for g, vs in values.items():
        s = sorted(vs)
        assert (got[g].n, got[g].low, got[g].third, got[g].last, got[g].none) == (len(s), s[0], s[len(s) // 3], s[-1], None)


@pytest.mark.parametrize("seed", range(3))
def test_pre_order_against_recursion(spark, seed):
    rng = random.Random(seed)
    parent = {f"n{k}": (f"n{rng.randrange(k)}" if k and rng.random() < 0.9 else None) for k in range(60)}
    weight = {k: rng.choice((None, 0, 1, 2)) for k in parent}
    df = spark.createDataFrame([(k, p, weight[k]) for k, p in parent.items()], "id string, parent string, w int")
    children = lambda i: sorted((k for k, p in parent.items() if p == i), key=lambda k: (weight[k] or 0, k))

    def visit(i, level=1):
        yield i, level
        for c in children(i):
            yield from visit(c, level + 1)

    starts = ["n0", "n5"]
    plain = sorted((i, level, place) for s in starts for place, (i, level) in enumerate(visit(s), 1))
    got = trees.pre_order(df, spark.createDataFrame([(s,) for s in starts], "id string"), F.col("w")).collect()
    assert sorted((r.id, r.level, r.place) for r in got) == plain


def test_listed_documents_and_first_source(spark, tmp_path):
    for name in ("poc-b.json", "poc-a.json", "x-index.json", "index.json", "poc-metrics.json", "other.json"):
        (tmp_path / name).write_text(json.dumps({"n": name}))
    (tmp_path / "poc-c.json").write_text("{broken")
    found = readers.listed_documents(spark, str(tmp_path), ("poc-*.json", "*-index.json", "index.json"), ("poc-metrics.json", "x*.json"))
    assert [r.name for r in found.collect()] == ["index.json", "poc-a.json", "poc-b.json"]
    source = readers.first_source(lambda: spark.table("no_such_table"), lambda: spark.read.text(str(tmp_path / "index.json")))
    assert source.count() == 1
    with pytest.raises(Exception, match="no_such_other"):
        readers.first_source(lambda: spark.table("no_such_table"), lambda: spark.table("no_such_other"))


def test_styles(spark):
    styles = {"soft": {"header": "soft page", "positive": "pale $1 colours", "negative": "dark", "remove_positive": [r"\bno shading\b,?"], "remove_negative": ["grey"]}}
    rows = spark.createDataFrame([("soft", "Coloring book page for kids, a cat, no shading, ,  thick lines, ", "blur, Grey,"), ("none", "as it is,", "x")], "s string, p string, n string")
    got = [tuple(r.o) for r in rows.select(text.styled(F.col("p"), F.col("n"), F.col("s"), styles).alias("o")).collect()]
    assert got == [("soft page, a cat, thick lines, pale $1 colours", "blur, dark"), ("as it is,", "x")]
    assert {r.name for r in text.vocabulary_sizes(spark).filter("words > 5").collect()} == {"color_nouns", "color_anchors", "glossy_terms", "solid_terms"}


def test_colours_back_and_palettes(spark):
    rgb = spark.createDataFrame([(r, g, b) for r in (0, 3, 90, 255) for g in (0, 128, 255) for b in (0, 11, 254)], "r int, g int, b int")
    assert all(tuple(x.c) == (x.r, x.g, x.b) for x in rgb.select("*", colors.lab_to_rgb(colors.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))).alias("c")).collect())
    at = lambda c: spark.range(1).select(c).first()[0]
    assert at(colors.auto_palette(F.lit(3), "rainbow")) == [[230, 50, 50], [50, 230, 50], [50, 50, 230]]
    assert at(colors.auto_palette(F.lit(0))) == []
    assert at(colors.auto_palette(F.lit(6), "pastel"))[1] == [240, 240, 165]


def test_pages_and_first_rows(spark):
    rows = spark.createDataFrame([(k, k % 3 == 0, k % 2 == 0) for k in range(30)], "id int, cheap boolean, exact boolean")
    page = lambda **how: [r.id for r in lookups.cut_then_match(rows, F.col("cheap"), F.col("exact"), [F.col("id")], 4, **how).collect()]
    assert page() == [0, 6] and page(cut_first=False) == [0, 6, 12, 18] and page(offset=4) == [12, 18]
    assert [tuple(r) for r in lookups.first_row(rows, [], "exact", "id").collect()] == [(1, False, False)]
    assert lookups.first_row(rows.limit(0), [], "id").collect() == []
    sample = [r.id for r in lookups.seeded_sample(rows, "id", 5, 1).collect()]
    assert sample == sorted(sample) == [r.id for r in lookups.seeded_sample(rows.repartition(5), "id", 5, 1).collect()] and len(sample) == 5
    assert len(lookups.seeded_sample(rows, "id", 99, 1).collect()) == 30
    assert [(r.id, r.place) for r in arrays.largest(rows.withColumn("a", -F.col("id")), "a", "id", 2).collect()] == [(0, 1), (1, 2)]
