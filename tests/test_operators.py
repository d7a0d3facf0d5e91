"""Operators on literal rows: the cases the driver's tables lack."""

import datetime as dt

from pyspark.sql import functions as F

from tessella.operators import arrays, changes, images, jobs, rules, summaries, tables, trees
from tessella.plans import export

JOBS = "id string, type string, status string, duration_ms int, created_at string, priority int"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_job_stats_round_half_even_and_null(spark):
    j = spark.createDataFrame([("1", "a", "completed", 2, "t", 5), ("2", "a", "completed", 3, "t", 5), ("3", "a", "pending", None, "t", 5), ("4", "b", "failed", 9, "t", 5)], JOBS)
    assert rows(jobs.stats(j), "type", "pending", "failed", "avg_duration") == [("a", 1, 0, 2), ("b", 0, 1, None)]


def test_claims_gate_and_recovery(spark):
    j = spark.createDataFrame([("1", "a", "pending", None, "2", 5), ("2", "a", "pending", None, "1", 5), ("3", "a", "pending", None, "9", 1), ("4", "b", "running", None, "1", 5)], JOBS)
    assert rows(jobs.claim(j.filter("status = 'pending'"), F.lit(2)), "id", "rank") == [("2", 2), ("3", 1)]
    config = spark.createDataFrame([("a", 2), ("b", 0), ("c", None)], "type string, max_concurrent int")
    assert rows(jobs.free_slots(j, config)) == [("a", 2, 0, 2), ("b", 1, 1, 0), ("c", 1, 0, 1)]
    now = dt.datetime(2024, 1, 1, 12)
    r = spark.createDataFrame([(1, "running", None), (2, "running", now - dt.timedelta(minutes=6)), (3, "running", now), (4, "failed", None)], "id int, status string, beat timestamp")
    assert rows(jobs.recover_stale(r, "beat", F.lit(now)), "id", "status") == [(1, "pending"), (2, "pending"), (3, "running"), (4, "failed")]


def test_retry_purge_and_bulk(spark):
    at = dt.datetime(2024, 1, 1)
    f = spark.createDataFrame([(1, 0, at), (2, 2, at), (3, 3, at)], "id int, retry int, at timestamp")
    got = rows(jobs.plan_retry(f, "retry", 3, "at"), "id", "next_status", "next_retry", (F.unix_timestamp("scheduled_at") - F.unix_timestamp("at")).alias("s"))
    assert got == [(1, "pending", 1, 60), (2, "pending", 3, 900), (3, "failed", 3, None)]
    p = spark.createDataFrame([(1, "failed", "2023"), (2, "failed", None), (3, "pending", "2023")], "id int, status string, finished string")
    assert rows(jobs.purge(p, "status", "finished", F.lit("2024")), "id") == [(2,), (3,)]
    s = jobs.set_status(p, p.select("id"), "id", "status", ("pending",), "cancelled")
    assert rows(s, "id", "status", "changed") == [(1, "failed", False), (2, "failed", False), (3, "cancelled", True)]


def test_filters_and_pages(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "", 7)], "id int, k string, v int")
    assert rows(tables.where(df), "id") == [(1,), (2,), (3,)]
    assert rows(tables.where(df, among={"k": ["a", "b"]}, equal={"v": None}), "id") == [(1,), (2,)]
    assert rows(tables.where(df, blank={"k": True}), "id") == [(3,)]
    assert [r.id for r in tables.ordered(df, "v", "desc", ("id", "v"), "id").collect()] == [3, 1, 2]
    assert [r.id for r in tables.ordered(df, "nope", "up", ("id", "v"), "id").collect()] == [1, 2, 3]
    assert [r.id for r in tables.page(df.orderBy("id"), 2, 2).collect()] == [3]


def test_longest_prefix(spark):
    names = spark.createDataFrame([("a_b_c",), ("a_bx",), ("z",), ("a",), (None,)], "name string")
    known = spark.createDataFrame([("a",), ("a_b",)], "key string")
    assert rows(tables.longest_prefix(names.filter("name is not null"), "name", known, "key"), "name", "match") == [("a", "a"), ("a_b_c", "a_b"), ("a_bx", "a"), ("z", None)]


def test_samples_are_stable(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("c"))
    one, two = rows(tables.sample_per_class(df, "c", "id", 4, 1)), rows(tables.sample_per_class(df.repartition(7), "c", "id", 4, 1))
    assert one == two and len(one) == 12


def test_unique_slugs_follow_the_greedy_order(spark):
    data = [
        (1, "x", ["en/a", "fr/b"]), (2, "x", ["en/c"]), (3, "y", ["en/a", "fr/d"]), (4, "z", ["fr/d", "en/e"]),
        (5, "u", ["en/e"]), (6, "y2", ["en/q"]), (7, "y", ["en/r"]),
    ]
    df = spark.createDataFrame([(i, r, [tuple(p.split("/")) for p in ps]) for i, r, ps in data], "id int, r2 string, posts array<struct<locale:string,slug:string>>")
    held_r2, held, want = set(), set(), []
    for i, r, ps in data:
        if r in held_r2:
            want.append((i, "r2_taken"))
            continue
        held_r2.add(r)
        if held & set(ps):
            want.append((i, "slug_taken"))
            continue
        held |= set(ps)
        want.append((i, "kept"))
    assert rows(tables.unique_slugs(df, "id", "r2", "posts"), "id", "outcome") == want


def test_trees(spark):
    nodes = spark.createDataFrame([("a", None, 2), ("b", "a", None), ("c", "b", 1), ("d", "a", 1), ("x", "gone", 1), ("r", None, 1)], "id string, parent string, weight int")
    assert rows(trees.walk(nodes), "id", "level", "root") == [("a", 1, "a"), ("b", 2, "a"), ("c", 3, "a"), ("d", 2, "a"), ("r", 1, "r")]
    assert rows(trees.leaves(nodes), "id") == [("c",), ("d",), ("r",), ("x",)]
    assert rows(trees.orphans(nodes), "id") == [("x",)]
    nested = dict(rows(trees.nested(nodes, F.col("weight"))))
    assert nested["r"] == '{"id":"r"}' and nested["a"].index('"b"') < nested["a"].index('"d"')
    report = {r.name: (r.actual, r.ok) for r in trees.integrity(nodes, {"level_1": 2, "level_2": 2, "level_3": 1}).collect()}
    assert report["orphans"] == (1, False) and report["level_3"] == (1, True) and report["blank"] == (0, True)


def test_summaries(spark):
    df = spark.createDataFrame([("a", float(i), True) for i in range(1, 5)] + [("a", 100.0, False), ("b", None, False)], "k string, v double, ok boolean")
    assert rows(summaries.distribution(df, "k", "v")) == [("a", 5, 1.0, 3.0, 100.0, 100.0)]
    assert rows(summaries.latency(df, "k", "v", F.col("ok"), 2.0)) == [("a", 5, 4, 2.5, 4.0, 2.5, 0.4, 0.4), ("b", 1, 0, None, None, None, 0.0, 0.0)]
    d = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("b", None, None)], "k string, x int, y int")
    assert rows(summaries.defect_rates(d, "k", F.col("x").isNotNull(), F.col("x") == 1, F.col("y") == 1), "k", "n", "rate", "verdict") == [("a", 2, 0.5, "no_go"), ("b", 0, None, "waiting")]
    one = spark.range(1)
    assert one.select(summaries.weighted_score(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).first()[0] == 100.0
    assert one.select(summaries.baseline_verdict(F.lit(0.5), F.lit(10), 5), summaries.baseline_verdict(F.lit(0.1), F.lit(10), 5), summaries.baseline_verdict(F.lit(0.5), F.lit(1), 5)).first() == ("promotion", "withdrawal", "waiting")


def test_rules(spark):
    m = spark.createDataFrame([(True, 0.0, 80.0, 900, 0.1, "x"), (True, 0.5, 10.0, 1, 0.9, "rainbow"), (False, None, None, None, None, None), (True, 0.0, 80.0, 900, 0.1, "aurora_x")], "r boolean, c double, s double, e int, b double, leaf string")
    got = [r.t for r in m.select(rules.qc_tags(*(F.col(c) for c in m.columns)).alias("t")).collect()]
    assert got == [["qc_ok"], ["qc_color_residual", "qc_color_intrinsic", "qc_low_contrast", "qc_low_complexity", "qc_oversaturated"], ["qc_unreadable"], ["qc_color_intrinsic", "qc_ok"]]
    checks = rules.severities(*(F.lit(x) for x in (0.03, 0.5, 0.001, 0.5, 0.3, 0.1)))
    r = spark.range(1).select(checks.alias("c")).select(rules.technical_score(F.col("c")).alias("s"), rules.technical_status(F.col("c")).alias("t")).first()
    assert (r.s, r.t) == (round(100 * (0.65 + 1 + 0 + 1 + 0.65 + 0.65) / 6), "fail")
    pub = spark.createDataFrame([(1, loc, "t", "pending") for loc in rules.LOCALES] + [(2, "fr", " ", "pending"), (2, "de", "t", "bad")], "id int, locale string, title string, status string")
    assert rows(rules.publish_gate(pub, "id", "locale", ["title"], "status", ("pending",))) == [(1, [], [], 0, 0, 3, True), (2, ["ar", "en"], ["de"], 1, 1, 2, False)]


def test_changes(spark):
    cur = spark.createDataFrame([("a", "p", "A"), ("p", None, "P")], "id string, parent string, name string")
    ops = spark.createDataFrame(
        [(0, "add", "n", "p"), (1, "add", "m", "n"), (2, "add", "k", "later"), (3, "add", "later", None), (4, "add", "a", None), (5, "replace", "a", None), (6, "remove", "zz", "gone"), (7, "update", "zz", None), (8, "what", "a", None), (9, "add", " ", None), (10, None, "a", None)],
        "idx int, op string, id string, parent string",
    )
    got = {r.idx: (r.state, r.reason) for r in changes.validate(ops, cur, "id", "parent").collect()}
    assert got == {
        0: ("ready", None), 1: ("ready", None), 2: ("error", "missing_parent"), 3: ("ready", None), 4: ("conflict", "exists"), 5: ("update", None),
        6: ("skip", "nothing_to_remove"), 7: ("error", "not_found"), 8: ("error", "unknown_op"), 9: ("error", "missing_id"), 10: ("error", "unknown_op"),
    }
    new = spark.createDataFrame([("a", " A ", 5), ("p", "Q", None)], "id string, name string, weight int")
    d = changes.differences(new, cur.withColumn("weight", F.lit(4)), "id", ["name", "weight"])
    assert {r.id: [tuple(c) for c in r.changes] for r in d.collect()} == {"a": [("weight", "4", "5")], "p": [("name", "P", "Q")]}
    merged = changes.merge(cur, spark.createDataFrame([("a", None, "X"), ("b", "p", "B")], "id string, parent string, name string"), ["id"], ["parent"], ["name"])
    assert rows(merged, "id", "parent", "name", "action") == [("a", "p", "A", "UPDATE"), ("b", "p", "B", "INSERT"), ("p", None, "P", "KEEP")]


def test_images(spark):
    clean = [255] * 300
    for x in range(30, 60, 3):
        clean[x : x + 3] = [0, 0, 0]
    df = spark.createDataFrame([(1, 10, 10, clean), (2, 10, 10, [255, 0, 0] * 100), (3, 4, 4, [0] * 48), (4, 10, 10, None)], "id int, h int, w int, rgb array<int>")
    got = {r.id: r.m for r in df.select("id", images.qc_metrics(F.col("h"), F.col("w"), F.col("rgb")).alias("m")).collect()}
    assert got[1].black_ratio == 0.1 and got[1].color_ratio == 0.0 and got[1].edge_count > 0
    assert got[2].color_ratio == 1.0 and got[2].edge_count == 0 and not got[3].readable and not got[4].readable


def test_components_and_openness(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    for _ in range(20):
        g = rng.integers(0, 3, (7, 9))
        got = images.connected(g)
        seen = np.full(g.shape, -1)
        for y, x in np.ndindex(g.shape):  # flood fill
            if seen[y, x] < 0:
                todo, seen[y, x] = [(y, x)], y * 9 + x
                while todo:
                    a, b = todo.pop()
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < 7 and 0 <= d < 9 and seen[c, d] < 0 and g[c, d] == g[a, b]:
                            seen[c, d] = y * 9 + x
                            todo.append((c, d))
        assert (got == seen).all()
    ring = np.ones((5, 5), bool)
    ring[1:4, 1:4] = False
    ring[2, 2] = True
    assert abs(images.openness(ring) - 16 / 17) < 1e-12
    assert images.bayer(2) == [[0, 2], [3, 1]]


def test_region_kernels(spark):
    px = spark.createDataFrame([(1, 0, x, r) for x, r in enumerate([1, 1, 2, 3])] + [(1, 1, x, r) for x, r in enumerate([1, 1, 1, 3])], "image long, y int, x int, region int")
    assert rows(arrays.adjacency(px)) == [(1, 1, 2), (1, 1, 3), (1, 2, 3)]
    assert rows(arrays.small_into_majority(px, 2)) == [(1, 2, 1)]
    reg = spark.createDataFrame([(1, 1, 5, 50.0, 0.0, 0.0), (1, 2, 1, 52.0, 0.0, 0.0), (1, 3, 2, 90.0, 0.0, 0.0)], "image long, region int, area int, L double, a double, b double")
    assert rows(images.merge_regions(reg, arrays.adjacency(px), 5.0)) == [(1, 1, 1), (1, 2, 1), (1, 3, 3)]
    lab = spark.createDataFrame([(float(x), 0.0, 0.0) for x in (0, 1, 99, 100)], "L double, a double, b double")
    assert sorted(round(r.L, 1) for r in images.palette(lab, 2).collect()) == [0.5, 99.5]


def test_export(spark):
    text = "x" * 30
    leaf = lambda i, en, ar="أسد", status="ok", title=text: (i, en, en, ar, status, title, text, text, text, text, text)
    names = "leaf_id string, name_en string, name_fr string, name_ar string, status string, title_fr string, title_en string, title_ar string, description_fr string, description_en string, description_ar string"
    leaves = spark.createDataFrame([leaf("lion", "Lion"), leaf("lion_cub", "Lion Cub", "قط"), leaf("bad", "Bad", status="failed"), leaf("short", "Short", title="x"), leaf("bare", "Bare", "با"), leaf("lion_two", "Lion!", "تو")], names)
    notes = spark.createDataFrame([("d/lion_cub_1.png", 3, "1"), ("d/lion_cub_2.png", 5, "1"), ("d/lion_9.png", 4, "1"), ("d/lion_two_1.png", 4, "1"), ("d/short_1.png", 4, "1"), ("d/bad.png", 4, "1"), ("d/bare.png", 0, "1")], "target_id string, score int, updated_at string")
    best = export.best_images(notes, leaves)
    assert ("lion_cub", "d/lion_cub_2.png", 5) in rows(best)
    decided = export.decide(leaves, best)
    assert rows(decided, "leaf_id", "outcome") == [("bad", "status"), ("bare", "no_image"), ("lion", "kept"), ("lion_cub", "kept"), ("lion_two", "r2_taken"), ("short", "hard_caps")]
    posts = export.posts(decided, "2024-01-01").collect()
    assert len(posts) == 6 and {p.slug for p in posts if p.leaf_id == "lion"} == {"lion", "asd"}
    assert {p.categoryId for p in posts} == {"animals_lions"}
