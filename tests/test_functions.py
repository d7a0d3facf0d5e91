"""Column functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import colors, jsonx, text, values


def apply(spark, fn, *rows, schema="c string"):
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return [r.x for r in spark.createDataFrame(rows, schema).select(fn.alias("x")).collect()]



def test_filters_keep_protected_contexts(spark):
    C = F.col("c")
    pairs = {
        "a red apple on a blue plate": "a apple on a plate",
        "simple line drawing": "simple line drawing",
        "round orange with leaf": "round orange with leaf",
        "an orange car, orange slice of an orange slice": "an car, slice of an orange slice",
        "RED carpet and red car": "RED carpet and car",
        "": "",
    }
    assert apply(spark, text.strip_colors(C), *pairs) == list(pairs.values())
    assert apply(spark, text.replace_anchors(C), "fire and flame", "a rainbow over the mountain", "Fall  Season") == ["flame shape and flame shape", "a colorful over the mountain", "seasonal scene"]
    assert apply(spark, text.strip_glossy(C), "a shiny metallic sphere", "tall drinking glass", "glass of milk in a glass house") == ["a sphere", "tall drinking glass", "glass of milk in a house"]
    assert apply(spark, text.strip_solid(C), "a shaded volumetric ball with realistic textures", None) == ["a ball with", None]
    assert apply(spark, text.filter_prompt(C), "a shiny red rainbow chocolate egg with realistic textures") == ["a colorful egg with"]
    assert apply(spark, text.filter_prompt(C), "infrared redwood") == ["infrared redwood"]


def test_slugs(spark):
    C = F.col("c")
    got = apply(spark, text.r2_slug(C), "Lion in Savanna", "Éid al-Adha Sheep", "42 Apples", "", "x", None)
    assert [(r.slug, r.error) for r in got] == [("lion-in-savanna", None), ("eid-al-adha-sheep", None), (None, "invalid"), (None, "empty"), (None, "too_short"), (None, "missing")]
    got = apply(spark, text.post_slug(C, F.col("l")), ("Lion dans la Savane", "fr"), ("أسد", "ar"), ("قِطّـة", "ar"), ("x", "de"), schema="c string, l string")
    assert [(r.slug, r.error) for r in got] == [("lion-dans-la-savane", None), ("asd", None), ("qta", None), (None, "locale")]
    known = F.create_map(F.lit("أسد"), F.lit("asad"), F.lit("الغابة"), F.lit("al-ghaba"), F.lit("في"), F.lit("fi"))
    assert apply(spark, text.arabic_slug(C, known=known), "أسد في الغابة") == ["asad-fi-al-ghaba"]
    assert apply(spark, text.fold_any(C), "ﬁné Ώ", None) == ["fine Ω", None]
    assert apply(spark, text.short_slug(C), "Hello World!", "??") == ["hello-world", "concept"]


def test_names_and_paths(spark):
    C = F.col("c")
    got = apply(spark, text.filename_parts(C), "lion_cub_8s_cfg35_42.png", "plain_name.png", "a_9.png")
    assert [tuple(r) for r in got] == [("lion_cub", 8, 3.5, 42), ("plain_name", None, None, None), ("a_9", None, None, 9)]
    assert apply(spark, text.last_segment(C), "https://x.org/a/b-c/?q=1", "/a/b/", "bare?x", "https://x.org") == ["b-c", "b", "bare?x", ""]
    assert apply(spark, text.leaf_id(C), "benchmark:run/lion_cub_512x512_1", "lion-cub") == ["lion_cub", "lion_cub"]
    assert apply(spark, text.stem(C), "a/b/c.tar.gz", "x", ".hidden") == ["c.tar", "x", ".hidden"]


def test_categories(spark):
    C = F.col("c")
    leaves = {"lion_cub": "animals_lions", "snowy_owl": "animals_birds", "blue_whale": "animals_marine", "grumpy_cat": "animals_pets", "cat_like_panther": "objects_things", "red_fox": "animals_wild", "tour_guide": "general_humans", "letter_a": "letters_arabic", None: "objects_things", "": "objects_things"}
    assert apply(spark, text.category(C), *[(k,) for k in leaves]) == list(leaves.values())
    assert apply(spark, text.intrinsic_color(C), "rainbow", " Crystal_ball", "rainbows", None) == [True, True, False, False]


def test_prompt_edits(spark):
    C = F.col("c")
    assert apply(spark, text.inject_background(C, "green screen"), "an illustration, of x", "plain", "green screen here") == ["an illustration, green screen, of x", "green screen, plain", "green screen here"]
    assert apply(spark, text.restyle(C, "HEAD:", "NEW:", ["bold"], ", ok"), "HEAD: a, bold, b", "x") == ["NEW: a, b, ok", "x, ok"]


def test_json(spark):
    C = F.col("c")
    assert apply(spark, jsonx.i18n(C, "fr"), '{"fr":"a"}', '{"en":"b"}', "bad", None) == ["a", "", "", ""]
    assert apply(spark, jsonx.to_i18n(fr=C, en=F.lit(" ")), "x", "") == ['{"fr":"x"}', "{}"]
    got = apply(spark, jsonx.reply_json(C), '{"a":1}', '<think>{"no":1}</think> {"a":2}', '```json\n{"a":3}\n```', 'so: {"a":{"b":4}} end', '{"a":')
    assert got == ['{"a":1}', '{"a":2}', '{"a":3}', '{"a":{"b":4}}', None]
    assert apply(spark, jsonx.object_or_null(C).isNull(), '{"a":1}', "[1]", "3", "bad", None) == [False, True, True, True, True]
    assert apply(spark, jsonx.unwrap_list(C), "[1]", '{"items":[2]}', '{"x":3}') == ["[1]", "[2]", None]
    m = spark.sql("select map('a','1','b','2') cur, map('a','9','c','8') new").select(F.to_json(jsonx.merge_fields(F.col("cur"), F.col("new"), ["a"])).alias("x")).first().x
    assert sorted(m.strip("{}").split(",")) == ['"a":"9"', '"b":"2"']


def test_values(spark):
    C = F.col("c")
    assert apply(spark, values.first_nonblank(C, F.lit("d")), "", "a", None) == ["d", "a", "d"]
    assert apply(spark, values.to_int(C), "3", "x", None) == [3, 0, 0]
    assert apply(spark, values.positive_or(F.col("c"), 1), 0, None, 4, schema="c int") == [1, 1, 4]
    assert apply(spark, values.missing_fields(a=C, b=F.lit("x")), "", "y") == [["a"], []]
    assert apply(spark, values.half_even(F.col("c")), 2.5, 3.5, schema="c double") == [2.0, 4.0]
    assert apply(spark, values.index_median(C), [1, 2, 3, 4], [1], schema="c array<int>") == [3, 1]
    assert apply(spark, values.rank_quantile(C, 0.95), list(range(10)), schema="c array<int>") == [9]
    assert apply(spark, values.index_quantile(C, 0.9), list(range(10)), schema="c array<int>") == [9]
    assert apply(spark, values.retry_delay(C), 0, 1, 2, 7, schema="c int") == [60, 300, 900, 900]
    assert apply(spark, values.duration_ms(C, F.col("e")), ("2024-01-01T00:00:00Z", "2024-01-01T01:00:02+01:00"), ("bad", "2024-01-01T00:00:00Z"), schema="c string, e string") == [2000, None]
    assert apply(spark, values.clean_list(C), [" a", "a", "", "b"], schema="c array<string>") == [["a", "b"]]
    assert apply(spark, values.unknown_items(C, ["a"]), ["z", "a", "b", "z"], schema="c array<string>") == [["b", "z"]]
    assert apply(spark, values.safe_path_part(C), "a-b.png", "..", "a/b") == [True, False, False]


def test_colors(spark):
    C = F.col("c")
    lab = apply(spark, colors.rgb_to_lab(C, C, C), 255.0, 0.0, schema="c double")
    assert lab[0].L == pytest.approx(100, abs=0.01) and abs(lab[0].a) < 0.02 and lab[1].L == pytest.approx(0, abs=1e-6)
    assert apply(spark, colors.hex_to_rgb(C), "#00B140", "ff0001") == [[0, 177, 64], [255, 0, 1]]
    assert apply(spark, colors.rgb_to_hex(C, C + 1, F.lit(0)), 15, schema="c int") == ["#0f1000"]
    assert apply(spark, colors.posterize(C, 4), 0, 63, 64, 255, schema="c int") == [0, 0, 64, 192]
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    schema = "c array<struct<x:double,y:double>>"
    assert apply(spark, colors.polygon_area(C), (square,), schema=schema) == [4.0]
    assert apply(spark, colors.polygon_area(colors.chaikin(C)), (square,), schema=schema) == [3.5]
    assert apply(spark, colors.hue_palette(C), 4, schema="c int") == [[0, 45, 90, 135]]
