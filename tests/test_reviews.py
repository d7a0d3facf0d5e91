"""Edits, lookups, annotations, templates and rules on literal rows, and every query against its SQL."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.functions import artifacts, jsonx, templates
from tessella.operators import changes, edits, images, lookups, rules, summaries, trees
from tessella.plans import bound

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def one(spark, column, **values):
    kinds = {str: "string", int: "int", list: "array<string>", dict: "map<string,string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "z int")
    return df.select(column.alias("x")).first().x


def plain(df):
    def value(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) else x if isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(value(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def sql(sf_dir):
    import os

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(bound.SQL))
def test_query_agrees_with_its_sql(spark, sf_dir, sql, name):
    got, want = plain(bound.QUERIES[name](spark, sf_dir).toPandas()), plain(sql.execute(bound.SQL[name]).df())
    assert got == want
    assert want[1] or name == "variants_missing"  # all of its pairs exist in the smallest tables


def test_entry_lists_all_queries():
    assert set(bound.QUERIES) <= set(entry.queries()) and set(bound.SQL) <= set(entry.oracle_sql())


def test_last_effective_op_decides(spark):
    cur = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id int, name string, n int")
    ops = spark.createDataFrame([(0, "upsert", 1, "x", None), (1, "remove", 1, None, None), (2, "add", 4, "d", 4), (3, "upsert", 2, None, 9), (4, "update", 3, "z", 0), (5, "add", 2, "no", 0)], "idx int, op string, id int, name string, n int")
    done = edits.apply_ops(changes.validate(ops, cur, "id"), cur, "id", ["name", "n"])
    assert rows(done) == [(2, "b", 9), (3, "c", 3), (4, "d", 4)]
    again = spark.createDataFrame([(0, "remove", 1, None, None), (1, "upsert", 1, "back", None)], "idx int, op string, id int, name string, n int")
    assert (1, "back", 1) in rows(edits.apply_ops(changes.validate(again, cur, "id"), cur, "id", ["name", "n"]))


def test_merge_takes_one_row_a_key(spark):
    cur, inc = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (1, "c"), (2, "d")], "id int, v string")
    assert rows(changes.merge(cur, inc, ["id"], ["v"])) == [(1, "c", "UPDATE"), (2, "d", "INSERT")]


def test_deletes(spark):
    deep = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(25)] + [("x", "y"), ("y", "x")], "id string, parent string")
    assert trees.walk(deep).count() == 25  # deeper than any fixed number of levels; a circle is not entered
    assert rows(trees.walk(deep, deep.filter("id = 'x'")), "id", "level") == [("x", 1), ("y", 2)]
    assert len(rows(edits.cascade_delete(deep, deep.filter("id = '3'")))) == 5
    wanted = spark.createDataFrame([("24",), ("3",), ("q",)], "id string")
    got = edits.guarded_delete(deep, wanted, {"refs": (deep.limit(0).select("id"), "id")})
    assert rows(got, "id", "outcome") == [("24", "deleted"), ("3", "has_children"), ("q", "not_found")]
    assert rows(edits.guarded_delete(deep, wanted, {"refs": (deep.limit(0).select("id"), "id")}, cascade=True), "id", "outcome") == [("24", "deleted"), ("3", "deleted"), ("q", "not_found")]


def test_eligible_counts_each_id_once(spark):
    items = spark.createDataFrame([("a", "ready", "p"), ("b", "ready", " "), ("c", None, "p"), ("d", "ready", "p")], "id string, status string, prompt string")
    jobs = spark.createDataFrame([("d", "running"), ("a", "done")], "id string, status string")
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), ("e",)], "id string")
    got = edits.eligible(asked, items, "id", "status", "prompt", jobs, "ready", ("running", "pending"))
    assert rows(got) == [("a", None), ("b", "empty_prompt"), ("c", "status_blank"), ("d", "active_job"), ("e", "unknown")]


def test_contained_names_across_words(spark):
    names = spark.createDataFrame([("other one", 2), ("the", 3), ("", 0), ("q", 1)], "name string, rank int")
    texts = spark.createDataFrame([("an other one",), ("bother",), ("so",), ("",), (None,), ("q",)], "t string")
    got = dict(rows(lookups.first_contained(texts, "t", names, "name", "rank"), "t", "match"))
    assert got == {"an other one": "other one", "bother": "the", "so": None, "": None, None: None, "q": "q"}


def test_order_statistics_against_sorting(spark):
    import random

    rng = random.Random(1)
    data = {g: [rng.randrange(20) for _ in range(n)] for g, n in (("a", 1), ("b", 10), ("c", 57))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None)], "g string, v double")
    got = {r.g: r for r in summaries.distribution(df, "g", "v").collect()}
    for g, vs in data.items():
        s = sorted(vs)
        assert (got[g].n, got[g].min, got[g].median, got[g].p90, got[g].max) == (len(s), s[0], s[len(s) // 2], s[int(len(s) * 0.9)], s[-1])


def test_annotations(spark):
    m = artifacts.migrate_annotation(F.col("e"))
    got = one(spark, m, e='{"score": 99, "defects": ["2_objets", "2_objets", "zz"], "notes": "[\\"trop_chargé\\", \\"mine\\", \\"\\"]"}')
    assert (got.score, got.score_legacy, got.image_tags, got.custom_tags) == (None, None, ["image_duplication", "image_complexe"], ["mine"])
    assert got.anomalies == ["score out of [1,10]: 99", "unknown defect: zz"]
    new = one(spark, m, e='{"score": 5, "flags": {}, "defects": ["zz"]}')
    assert (new.score, new.image_tags, new.anomalies) == (5, [], [])
    row = artifacts.annotation_row(F.col("e"), ["a"], ["p"])
    assert one(spark, row, e="no json").anomalies == ["entry not an object"]
    assert one(spark, row, e='{"flags": {"pattern": false, "pattern_note": "n"}}').pattern_note == ""
    assert one(spark, artifacts.proposal(F.col("e")), e='{"a": 1}') == '{"a": 1}'


def test_templates_and_lists(spark):
    assert one(spark, templates.yaml_text(F.col("c")), c='a "b" \\ \n') == '"a \\"b\\" \\\\ \\n"'
    assert one(spark, templates.yaml_list(F.col("c")), c=[]) == " []"
    aligned = templates.align(F.col("w"), F.col("p"))
    assert [tuple(x) for x in one(spark, aligned, w=["البيت", "كبير"], p=["al", "bayt", "kabir"])] == [("البيت", "al-bayt"), ("كبير", "kabir")]
    assert one(spark, aligned, w=["كبير"], p=["a", "b"]) is None
    assert one(spark, jsonx.unwrap_list(F.col("c")), c='{"b": 1}') is None
    rule = [templates.Rule("r", "replace", phrases={"a.b": "$x"})]
    assert one(spark, templates.rewrite(F.col("c"), rule), c="A.B axb").text == "$x axb"
    assert one(spark, rules.enqueue_error(F.lit("image_prompt_suggest"), F.col("c")), c='{"title": "t", "count": "2"}') is None
    assert one(spark, rules.enqueue_error(F.lit("image_prompt_suggest"), F.col("c")), c='{"title": "t", "count": 1.5}') == "count not in [1,5]"


def test_neighbourhoods_at_the_border(spark):
    px = spark.createDataFrame([(1, y, x, 0 if (y, x) != (2, 2) else 1) for y in range(3) for x in range(3)], "image long, y int, x int, region int")
    inside = {(r.y, r.x) for r in images.interior(px).filter("interior").collect()}
    assert inside == {(0, 0), (0, 1), (0, 2), (1, 0), (2, 0)}
