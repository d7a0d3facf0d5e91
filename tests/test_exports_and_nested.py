"""Exports with commit and rollback, nested values, tree replacement, image files, the life cycle of jobs."""

import datetime as dt
import json
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.operators import images, nested
from tessella.sources import exports, pictures
from tessella.streaming import lifecycle, queue


def tree_of(path):
    return {str(p.relative_to(path)): (p.read_bytes(), p.stat().st_mtime_ns, p.stat().st_ino) for p in sorted(path.rglob("*")) if p.is_file()}


def posts(spark, n, word="text"):
    rows = [(loc, f"post-{k}", f"{word} {k} é", None) for k in range(n) for loc in ("fr", "ar")]
    return spark.createDataFrame(rows, "locale string, slug string, title string, card string").repartition(3)


def test_export_writes_changed_files_only(spark, tmp_path):
    root = tmp_path / "out"
    first = sorted(map(tuple, exports.export_keyed(posts(spark, 5), "locale", "slug", str(root)).collect()))
    assert [r[:2] for r in first] == [("ar", 5), ("fr", 5)]
    before = tree_of(root)
    assert json.loads(before["fr/post-3.json"][0]) == {"locale": "fr", "slug": "post-3", "title": "text 3 é", "card": None}
    assert set(before) == {"manifest.json", *(f"{loc}/post-{k}.json" for k in range(5) for loc in ("fr", "ar"))}
    assert sorted(map(tuple, exports.export_keyed(posts(spark, 5).repartition(1), "locale", "slug", str(root)).collect())) == first
    assert tree_of(root) == before  # a second run writes nothing
    changed = posts(spark, 5).withColumn("title", F.when(F.col("slug") == "post-1", "new").otherwise(F.col("title")))
    exports.export_keyed(changed, "locale", "slug", str(root))
    after = tree_of(root)
    assert {k for k in after if after[k] != before.get(k)} == {"manifest.json", "fr/post-1.json", "ar/post-1.json"}


def test_failed_tasks_leave_the_former_export(spark, tmp_path):
    root = tmp_path / "out"
    exports.export_keyed(posts(spark, 4), "locale", "slug", str(root))
    before = tree_of(root)
    broken = posts(spark, 4, "other").withColumn("title", F.when((F.col("slug") == "post-3") & (F.col("locale") == "ar"), F.raise_error(F.lit("halfway"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="halfway"):
        exports.export_keyed(broken, "locale", "slug", str(root))
    assert tree_of(root) == before and not list(root.glob(".staging*"))
    for bad in ("../x", "a/b", ".hidden", ""):
        with pytest.raises(Exception, match="no place"):
            exports.export_keyed(posts(spark, 2, "z").withColumn("slug", F.when(F.col("slug") == "post-1", bad).otherwise(F.col("slug"))), "locale", "slug", str(root))
    with pytest.raises(ValueError, match="more than one row"):
        exports.export_keyed(posts(spark, 2, "z").withColumn("slug", F.lit("same")), "locale", "slug", str(root))
    assert tree_of(root) == before


def test_failed_commit_is_rolled_back(tmp_path, monkeypatch):
    root = tmp_path / "out"
    (root / "fr").mkdir(parents=True)
    (root / "fr" / "a.json").write_text("old")
    writer = exports.KeyedWriter(str(root), "1")
    message = writer.write(iter([{"folder": "fr", "name": n, "content": f"new {n}"} for n in "abc"]))
    assert (message.staged, message.unchanged) == (3, 0) and (root / "fr" / "a.json").read_text() == "old"
    moves, real = [], os.replace

    def third_fails(a, b):
        moves.append(b)
        if len(moves) == 3:
            raise OSError("disk")
        real(a, b)

    monkeypatch.setattr(exports.os, "replace", third_fails)
    with pytest.raises(OSError, match="disk"):
        writer.commit([message, None])
    assert {k: v[0] for k, v in tree_of(root).items()} == {"fr/a.json": b"old"}


def test_write_whole(tmp_path):
    exports.write_whole(tmp_path / "d" / "x.json", b"1")
    exports.write_whole(tmp_path / "d" / "x.json", b"22")
    assert {k: v[0] for k, v in tree_of(tmp_path).items()} == {"d/x.json": b"22"}


def test_upload_plan_and_json_safe(spark):
    objects = spark.createDataFrame([(k, b"body", m) for k, m in (("same", "m"), ("other", "m"), ("legacy", "m"), ("legacy2", "m"), ("new", "m"), ("bare", None))], "key string, body binary, master_md5 string")
    tag = '"841a2d689ad86bd1611447453c22c6fc"'
    stored = spark.createDataFrame([("same", "x", "m"), ("other", tag, "n"), ("legacy", tag, None), ("legacy2", '"y"', ""), ("bare", tag, "m")], "key string, etag string, master_md5 string")
    assert {r.key: r.write for r in exports.upload_plan(objects, stored).collect()} == {"same": False, "other": True, "legacy": False, "legacy2": True, "new": True, "bare": True}
    rows = spark.createDataFrame([(1, b"\xc3\xa9", float("nan"), dt.date(2024, 1, 2)), (None, None, 1.5, None)], "a int, b binary, c double, d date")
    assert [json.loads(r.json) for r in exports.json_safe(rows).orderBy("json").collect()] == [{"a": 1, "b": "é", "c": None, "d": "2024-01-02"}, {"a": None, "b": None, "c": 1.5, "d": None}]


def random_value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {k: random_value(rng, depth - 1) for k in rng.sample("abcd", rng.randint(0, 3))}
    if depth and kind < 0.55:
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, 1, 2.5, "x", "é\"", ""])


def plain_leaves(value, path="", flat=False):
    if isinstance(value, dict) and value and not (flat and path and all(isinstance(v, str) for v in value.values())):
        for k, v in value.items():
            yield from plain_leaves(v, f"{path}.{k}" if path else k, flat)
    elif isinstance(value, list) and value and not flat:
        for i, v in enumerate(value):
            yield from plain_leaves(v, f"{path}[{i}]", flat)
    else:
        yield path, value


@pytest.mark.parametrize("flat", [False, True])
def test_deep_diff_against_recursion(spark, flat):
    rng = random.Random(7)
    pairs = [({"r": random_value(rng, 5), "t": {"fr": "a", "en": "b"}}, {"r": random_value(rng, 5), "t": {"fr": "a", "en": rng.choice("bc")}}) for _ in range(40)]
    frame = lambda n: spark.createDataFrame([(k, json.dumps(p[n])) for k, p in enumerate(pairs)], "k int, j string").select("k", F.parse_json("j").alias("doc"))
    plain = set()
    for k, (one, two) in enumerate(pairs):
        a, b = dict(plain_leaves(one, flat=flat)), dict(plain_leaves(two, flat=flat))
        for path in a.keys() | b.keys():
            if path not in a or path not in b or json.dumps(a[path]) != json.dumps(b[path]):
                plain.add((k, path, "added" if path not in a else "removed" if path not in b else "changed"))
    found = nested.deep_diff(frame(0), frame(1), "k", "doc", flat).collect()
    assert {(r.k, r.path, r.kind) for r in found} == plain and len(found) == len(plain)
    for r in found:
        for text, doc in ((r.current, pairs[r.k][0]), (r.proposed, pairs[r.k][1])):
            assert text is None or json.loads(text) == dict(plain_leaves(doc, flat=flat))[r.path]


def test_deep_diff_of_odd_keys_and_documents(spark):
    """Null and repeated keys, null documents, ambiguous and empty names, many levels: as a join of leaves by key and path."""
    deep = lambda v, n: {"d": deep(v, n - 1)} if n else [v, {}]
    one = [(None, {"a": 1}), (None, {"a": 1}), (1, {"a.b": 1, "c": 2}), (2, {"": {"x": 1}, "x": 2}), (3, {"a": 1, "b": 2}), (3, {"a": 2}), (4, None), (5, deep(1, 9)), (6, {"a": []}), (7, {"a": {"b": [1, 2]}}), (8, 5), (9, {"a": "x. \"y\": [z"}), (10, {"q": 1})]
    two = [(None, {"a": 1}), (1, {"a": {"b": 1}, "c": 3}), (2, {"": {"x": 1}, "x": 3}), (3, {"a": 1}), (3, {"a": 3}), (4, {"a": 1}), (5, deep(2, 9)), (6, {"a": {}}), (7, {"a": [{"b": 1}, 2]}), (8, [5]), (9, {"a": "x"}), (11, {"q": [[1]]})]
    frame = lambda rows: spark.createDataFrame([(k, None if d is None else json.dumps(d)) for k, d in rows], "k int, j string").select("k", F.parse_json("j").alias("doc"))
    plain = []
    a = [(k, p, json.dumps(v, separators=(",", ":"))) for k, d in one if d is not None for p, v in plain_leaves(d)]
    b = [(k, p, json.dumps(v, separators=(",", ":"))) for k, d in two if d is not None for p, v in plain_leaves(d)]
    same = lambda x, y: x[0] is not None and x[:2] == y[:2]
    for x in a:
        plain += [(*x[:2], "changed", x[2], y[2]) for y in b if same(x, y) and x[2] != y[2]]
        plain += [] if any(same(x, y) for y in b) else [(*x[:2], "removed", x[2], None)]
    plain += [(*y[:2], "added", None, y[2]) for y in b if not any(same(x, y) for x in a)]
    assert sorted(map(str, map(tuple, nested.deep_diff(frame(one), frame(two), "k", "doc").collect()))) == sorted(map(str, plain))


def test_deep_diff_writes_values_as_spark_does(spark):
    strings = [*map(chr, range(1, 0x80)), "\\u001f", "\\\\u00ab\x1f", "é\u2028\U0001f600", "x\x00y"]
    numbers = ["1", "-0", "1.50", "1e300", "-2.5E-7", "12345678901234567890123456789", "true", "null", "[]", "{}"]
    texts = [*map(json.dumps, strings), *numbers, '[[1.0,"\\u001f"],{"b":1,"a":{}}]']
    one = spark.createDataFrame([(i, json.dumps({"v": 0})[:-2] + t + "}") for i, t in enumerate(texts)], "k int, j string").select("k", F.parse_json("j").alias("doc"))
    two = one.select("k", F.parse_json(F.lit('{"w": 1}')).alias("doc"))
    for flat in (False, True):
        plain = nested.leaves(one, "k", "doc", flat).select("k", "path", F.lit("removed"), F.to_json("value")).collect()
        found = nested.deep_diff(one, two, "k", "doc", flat).filter("kind <> 'added'").select("k", "path", "kind", "current").collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, plain))


def test_deep_diff_stores_only_differences(spark, monkeypatch):
    docs = spark.range(200).select("id", F.parse_json(F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.struct(i.alias("n"))).alias("l"), "id"))).alias("doc"))
    other = docs.withColumn("doc", F.when(F.col("id") % 10 == 0, F.parse_json(F.regexp_replace(F.to_json("doc"), '"n":7}', '"n":0}'))).otherwise(F.col("doc")))
    stored, whole = [], type(docs).checkpoint

    def counted(self, *args):
        stored.append(whole(self, *args))
        return stored[-1]

    monkeypatch.setattr(type(docs), "checkpoint", counted)
    found = nested.deep_diff(docs, other, "id", "doc").collect()
    assert sorted(map(tuple, found)) == [(k, "l[6].n", "changed", "7", "0") for k in range(0, 200, 10)]
    assert sum(s.count() for s in stored) == len(found)


def plain_nodes(items, parent, level=1):
    out = []
    for place, item in enumerate(items):
        if not isinstance(item, dict) or not str(item.get("id") or "").strip():
            continue
        out.append((item["id"].strip(), parent, level, place, item.get("weight") or len(out)))
        out += plain_nodes(item.get("children") or [], item["id"].strip(), level + 1)
    return out


def test_taxonomy_of_ten_levels(spark, tmp_path):
    rng, ids = random.Random(3), iter(range(10_000))

    def grow(level):
        node = {"id": rng.choice([f"n{next(ids)}"] * 9 + [" "])}
        if rng.random() < 0.3:
            node["weight"] = rng.randint(0, 9)
        if level < 10:
            node["children"] = [grow(level + 1) for _ in range(rng.choice((0, 1, 1, 2)) if level > 1 else 3)] + ["no node"] * (rng.random() < 0.1)
        return node

    deep = {"id": "d1"}
    at = deep
    for k in range(2, 11):
        at["children"] = [{"id": f"d{k}"}]
        at = at["children"][0]
    doc = {"vocabularies": [{"id": "a", "terms": [deep, grow(1), grow(1)]}, {"id": "b", "terms": []}, {"id": "c", "terms": [{"id": "c1", "name_en": "C", "slug": "s"}]}]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=1))
    found = nested.taxonomy_file(spark, str(tmp_path / "t.json")).collect()
    plain = [(v["id"], *n) for v in doc["vocabularies"] for n in plain_nodes(v["terms"], None)]
    assert sorted(((r.vocabulary, r.id, r.parent, r.level, r.place, r.weight) for r in found), key=str) == sorted(plain, key=str)
    assert max(r.level for r in found) == 10
    (last,) = [r for r in found if r.id == "c1"]
    assert (last.slug, last.name_fr, last.name_en, last.name_ar, last.taxonomy_id, last.languages) == ("s", "c1", "C", "C", "universal_v0", ["fr", "en", "ar"])


def test_replace_tree(spark):
    tree = lambda *r: spark.createDataFrame(list(r), "id string, parent string, w int")
    old = tree(("a", None, 1), ("b", "a", 2))
    table, outcome = nested.replace_tree(old, tree(("y", "x", 3), ("x", None, 1), ("z", "y", 2)))
    assert sorted(r.id for r in table.collect()) == ["x", "y", "z"]
    assert sorted(map(tuple, outcome.collect())) == [("a", 0, "deleted"), ("b", 0, "deleted"), ("x", 1, "inserted"), ("y", 2, "inserted"), ("z", 3, "inserted")]
    faulty = tree(("r", None, 1), ("p", "q", 1), ("q", "p", 1), ("s", "p", 1), ("o", "gone", 1), ("u", "o", 1), (" ", "r", 1), ("t", "r", 1), ("t", "r", 2))
    table, outcome = nested.replace_tree(old, faulty)
    assert sorted(r.id for r in table.collect()) == ["a", "b"]
    assert sorted((r.id, r.outcome) for r in outcome.collect()) == [(" ", "refused: blank"), ("o", "refused: orphan"), ("p", "refused: cycle"), ("q", "refused: cycle"), ("s", "refused: cycle"), ("t", "refused: repeated")]


def png(path, pixels, grey=False):
    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(row if grey else [v for p in row for v in p]) for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if grey else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files(spark, tmp_path):
    rng = random.Random(1)
    color = [[tuple(rng.randrange(256) for _ in range(3)) for _ in range(11)] for _ in range(9)]
    png(tmp_path / "a.png", color)
    png(tmp_path / "b.png", [[rng.randrange(256) for _ in range(8)] for _ in range(8)], grey=True)
    png(tmp_path / "c.png", color[:7])
    (tmp_path / "d.png").write_bytes((tmp_path / "a.png").read_bytes()[:40])
    (tmp_path / "e.txt").write_text("no image")
    found = {r.path[-5:]: r for r in pictures.images(spark, str(tmp_path)).collect()}
    assert {k: (r.h, r.w, r.error) for k, r in found.items()} == {"a.png": (9, 11, None), "b.png": (8, 8, None), "c.png": (7, 11, "too_small"), "d.png": (None, None, "unreadable")}
    assert found["a.png"].rgb == [v for row in color for p in row for v in p]
    assert len(found["b.png"].rgb) == 192 and found["c.png"].rgb is None
    metrics = pictures.images(spark, str(tmp_path)).select("path", images.qc_metrics(F.col("h"), F.col("w"), F.col("rgb")).alias("m")).collect()
    assert {r.path[-5:]: r.m.readable for r in metrics} == {"a.png": True, "b.png": True, "c.png": False, "d.png": False}


START = dt.datetime(2024, 1, 1)


def event_files(folder, batches):
    folder.mkdir()
    for i, events in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"job_id": j, "status": s, "ts": (START + dt.timedelta(seconds=t)).isoformat()}) for j, s, t in events))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i,) * 2)


def event_stream(spark, folder):
    return spark.readStream.schema("job_id string, status string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(folder))


def test_late_events_do_not_revive_jobs(spark, tmp_path):
    event_files(tmp_path / "in", [[("a", "running", 0), ("b", "pending", 0)], [("a", "completed", 90)], [("a", "running", 60)], [("b", "pending", 900)], [("b", "pending", 1800)]])
    q = queue.follow(event_stream(spark, tmp_path / "in")).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert not [r for r in spark.table("late").collect() if r.job_id == "a" and r.stale]
    assert {r.status for r in spark.table("late").collect() if r.job_id == "a"} == {"running", "completed"}


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_life_cycle(spark, tmp_path, rocks):
    """Claims, saved results, retries after pauses, a stale job; a restart repeats no action."""
    batches = [
        [("ok", "pending", 0), ("bad", "pending", 0), ("slow", "pending", 0)],
        [("ok", "running", 10), ("bad", "running", 10), ("slow", "running", 10)],
        [("ok", "completed", 20), ("bad", "failed", 20)],
        [("ok", "running", 15), ("x", "pending", 200)],
    ]
    event_files(tmp_path / "in", batches)
    run = lambda: lifecycle.save_batches(lifecycle.actions(event_stream(spark, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(180)
    assert run()
    more = [[("bad", "failed", 300)], [("x", "completed", 1000)], [("bad", "failed", 1100)], [("x", "pending", 2600)], [("bad", "failed", 2700)], [("y", "pending", 4000)], [("y", "running", 4001)]]
    for i, events in enumerate(more):
        k = len(batches) + i
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"job_id": j, "status": s, "ts": (START + dt.timedelta(seconds=t)).isoformat()}) for j, s, t in events))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k,) * 2)
    assert run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({(r.job_id, r.step) for r in rows}) == len(rows)
    of = {j: [(r.action, r.attempt) for r in sorted(rows, key=lambda r: r.step) if r.job_id == j] for j in ("ok", "bad", "slow")}
    assert of["ok"] == [("claim", 1), ("saved", 1)]
    assert of["bad"] == [("claim", 1), ("claim", 2), ("claim", 3), ("claim", 4), ("dead", 5)]
    assert of["slow"] == [("claim", 1), ("recovered", 1), ("claim", 1)]
