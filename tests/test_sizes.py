"""Operators whose cost at size is a matter of their plan: same rows as a plain version, without what made them slow or large."""

from pyspark.sql import functions as F

import numpy as np
import pyarrow as pa
import pytest
from __spark_entry__ import queries
from pyspark.sql import functions as F
from tessella.functions import jsonx
from tessella.operators import edits, images


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replaced_sets_are_not_sorted(spark):
    """Rows with null, repeated and missing keys; without a broadcast the rows are not sorted either."""
    rows = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (None, 7), (3, 8)], "id long, tag long")
    new = spark.createDataFrame([(1, 9), (1, 9), (4, 4), (None, 1), (5, 5)], "id long, tag long")
    replaced = spark.createDataFrame([(1,), (1,), (3,), (5,), (None,)], "id long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = edits.replace_sets(rows, "id", new, replaced)
        assert "Sort" not in plan(found)
        assert sorted(map(tuple, found.collect()), key=str) == sorted([(2, 6), (None, 7), (1, 9), (5, 5)], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("records", [1, 3, 7, 1000])
def test_groups_across_batches(spark, records):
    """Groups that begin, end and go on at any place of an Arrow batch arrive whole and once, null keys too."""
    rows = [(k, n) for k, size in [(None, 5), (1, 1), (2, 9), (3, 3), (4, 1), (5, 30)] for n in range(size)]

    def sizes(table, at):
        heads = table["k"].take(at[:-1]).combine_chunks()
        whole = [table["n"][a:b].to_pylist() == list(range(b - a)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.RecordBatch.from_arrays([heads, pa.array(np.diff(at)), pa.array(whole)], ["k", "size", "whole"])

    default = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        found = images.in_groups(spark.createDataFrame(rows, "k long, n long"), ["k"], ["n"], sizes, "k long, size long, whole boolean").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", default)
    assert sorted(map(tuple, found), key=str) == sorted([(None, 5, True), (1, 1, True), (2, 9, True), (3, 3, True), (4, 1, True), (5, 30, True)], key=str)


@pytest.mark.parametrize("name", ["alike_regions", "border_arcs", "absorbed_regions", "silhouettes", "small_parts_merged", "image_palettes", "image_components"])
def test_images_share_batches(spark, sf_dir, name):
    """No pandas frame an image: small images go through Python many at a time."""
    found = plan(queries()[name](spark, sf_dir))
    assert "InPandas" not in found and "MapInArrow" in found


def test_silhouettes_compute_pixels_once(spark, sf_dir):
    """One join, of pixels with their image's colours; backgrounds and parts need none."""
    found = plan(queries()["silhouettes"](spark, sf_dir))
    assert found.count("HashJoin") + found.count("SortMergeJoin") <= 1 and found.count("MapInArrow") == 3


def test_wrapped_lists_take_an_object_apart_once(spark):
    """Arrays, named and other keys, strings that look like lists, bad text; objects are not parsed anew for each key."""
    texts = ["[1, 2]", '{"a": [5], "items": [1, {"x": "y"}]}', '{"a":[5,6],"b":[7]}', '{"items":"no","results":[1]}', '{"items":"[1]"}', "{}", None, "no json", '{"items":[1,2]', '{"items":[1],"items":[2]}']
    wanted = ["[1, 2]", '[1,{"x":"y"}]', "[5,6]", "[1]", "[1]", None, None, None, None, "[1]"]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", jsonx.unwrap_list(F.col("x")).alias("l"))
    assert [r.l for r in found.orderBy("i").collect()] == wanted
    assert plan(found).count("from_json") == 1 and "transform(array(from_json" in plan(found)
