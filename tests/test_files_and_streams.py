"""Readers, writers and the streaming queue."""

import datetime as dt
import json
import os

from tessella.sources import readers, writers
from tessella.streaming import queue


def test_documents_and_indexes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"subjects": [{"filename": "s.png"}, {"x": 1}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"results": {"leaf": {"filename": "l.png"}, "k.png": {"histogram": {}}}}))
    (tmp_path / "c.json").write_text("{broken")
    docs = readers.json_documents(spark, str(tmp_path))
    assert docs.count() == 2
    assert sorted(r.filename for r in readers.index_entries(docs).collect()) == ["k.png", "l.png", "s.png"]


def test_taxonomy(spark, tmp_path):
    tree = {"children": [{"id": "r", "name_fr": "R", "children": [{"id": "s", "weight": 7, "children": [{"id": "l"}]}, {"id": " ", "children": [{"id": "lost"}]}]}]}
    (tmp_path / "t.json").write_text(json.dumps(tree, indent=1))
    got = {r.id: (r.parent, r.weight) for r in readers.taxonomy(spark, str(tmp_path / "t.json")).collect()}
    assert got == {"r": (None, 0), "s": ("r", 7), "l": ("s", 0)}


def test_small_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ar,slug\nx, y\n,\n")
    assert [tuple(r) for r in readers.corpus(spark, str(tmp_path / "c.csv"), "ar", "slug").collect()] == [("x", "y")]
    for name, content in (("l.txt", "a # note\n\n#b\nc\n"), ("l.json", '["a", "d"]'), ("m.json", '{"e": 1}')):
        (tmp_path / name).write_text(content)
    ids = lambda n: sorted(r.id for r in readers.ids(spark, str(tmp_path / n)).collect())
    assert (ids("l.txt"), ids("l.json"), ids("m.json")) == (["a", "c"], ["a", "d"], ["e"])
    (tmp_path / "p.md").write_text('---\ntitle: "A: b"\nn: 1\n---\nbody\n')
    r = readers.front_matter(spark, str(tmp_path / "p.md")).first()
    assert r.fields == {"title": "A: b", "n": "1"} and r.body == "body\n"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.png").write_bytes(b"1")
    assert [(r.directory, r.files) for r in readers.directories(spark, str(tmp_path)).collect()] == [("d", 1)]


def test_paged(spark):
    def fetch(offset, limit):
        return [(i,) for i in range(offset, min(offset + limit, 23))]

    for lanes in (1, 3):
        assert sorted(r.n for r in readers.paged(spark, fetch, "n int", 5, lanes).collect()) == list(range(23))


def test_writers(spark, tmp_path):
    posts = spark.createDataFrame([("fr", "a"), ("fr", "b"), ("en", "c")], "locale string, slug string")
    one = sorted(tuple(r) for r in writers.export_posts(posts, str(tmp_path / "p")).collect())
    assert [r[:2] for r in one] == [("en", 1), ("fr", 2)]
    assert one == sorted(tuple(r) for r in writers.export_posts(posts.repartition(3), str(tmp_path / "p")).collect())
    assert spark.read.json(str(tmp_path / "p")).count() == 3
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, body string")
    none = spark.createDataFrame([], "id int, sha256 string")
    first = writers.write_changed(rows, "id", "body", none, str(tmp_path / "w")).collect()
    manifest = spark.createDataFrame([(r.id, r.sha256) for r in first], "id int, sha256 string")
    again = writers.write_changed(rows, "id", "body", manifest, str(tmp_path / "w"))
    assert not any(r.write for r in again.collect()) and spark.read.parquet(str(tmp_path / "w")).count() == 2
    rows.createOrReplaceTempView("some_rows")
    assert [tuple(r) for r in writers.dump(spark, str(tmp_path / "d"), ["some_rows"]).collect()] == [("some_rows", 2)]


def run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    finally:
        q.stop()


def test_stream_finds_stale_jobs(spark, tmp_path):
    at = lambda m: (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)).isoformat()
    (tmp_path / "in").mkdir()
    for i, events in enumerate([[("a", "running", 0), ("b", "running", 0)], [("b", "completed", 2), ("c", "pending", 30)], [("c", "running", 31)]]):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"job_id": j, "status": s, "ts": at(m)}) for j, s, m in events))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i,) * 2)  # files are read in order of time
    source = spark.readStream.schema("job_id string, status string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run(queue.follow(source), tmp_path, "followed")
    got = {(r.job_id, r.status, r.stale) for r in spark.table("followed").collect()}
    assert ("a", "pending", True) in got and ("b", "completed", False) in got and ("b", "pending", True) not in got
    run(queue.depth(source), tmp_path, "depths")
    assert {(r.status, r.n) for r in spark.table("depths").collect()} >= {("running", 2), ("completed", 1)}
