"""The pipeline's stages on the smallest tables and on odd rows."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(pipeline.STAGES) - 1:
            assert after.columns == columns, name
        else:
            assert set(columns) < set(after.columns)
        assert 0 < after.count() <= before
        docs, before = after, after.count()


def test_run(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 0


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_workers_need_little_memory(spark, sf_dir):
    """Of long texts a worker gets some MB at a time, and the classifier needs a small multiple of that."""
    import tracemalloc

    import pyarrow as pa

    from tessella.llm import quality

    own = spark.newSession()
    docs = own.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES[:4]:
        own.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(own, docs, sf_dir)

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

        long = own.range(40, numPartitions=1).selectExpr("repeat('some words ', 50000) AS text")
        assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) < 10_000_000
    texts = pa.array(["some words of a text, then more. " * 100] * 1000)
    tracemalloc.start()
    x = quality.features(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x) == 1000 and peak < 50_000_000


def _words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def _kept_of_classes(rows, wanted=0.8):
    """rows (id, text): the first of each component of alike texts, comparing all pairs."""
    import numpy as np

    from tessella.llm import nearduplicates, textnum

    kmers = [nearduplicates.labelled_kmers(textnum.word_hash(t or "")) if len(_words(t)) > 5 else None for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = kmers[i], kmers[j]
            same = (_words(rows[i][1]) or rows[i][1] or "") == (_words(rows[j][1]) or rows[j][1] or "")
            if a is not None and b is not None and min(len(a), len(b)) >= wanted * max(len(a), len(b)) and len(np.intersect1d(a, b)):
                same = same or nearduplicates.aligned_similarity(a, b) >= wanted
            if same:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [r for i, r in enumerate(rows) if find(i) == i]


def _without_repeats(rows, bar):
    """rows (id, text) in order of id: texts without later occurrences of sentence units, in runs of `bar` words."""
    import re

    seen, out = {}, []
    for n, (k, text) in enumerate(rows):
        units, at = [], 0
        for m in [*re.finditer(r"\n|(?<=[.!?])[ \t]", text or ""), None]:
            part = (text or "")[at : m.start() if m else None]
            if w := _words(part):
                first = re.search(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", part)
                units.append((at + first.start(), tuple(w)))
            at = m.end() if m else 0
        flags, here = [], set()
        for _, w in units:
            flags.append(seen.get(w, n) < n or w in here)
            here.add(w)
        for w in here:
            seen.setdefault(w, n)
        pieces, at, i = [], 0, 0
        while i < len(units):
            j = i
            while j < len(units) and flags[j] == flags[i]:
                j += 1
            if flags[i] and sum(len(w) for _, w in units[i:j]) >= bar:
                pieces.append(text[at : units[i][0]])
                at = units[j][0] if j < len(units) else len(text)
            i = j
        out.append((k, None if text is None else "".join(pieces) + text[at:]))
    return out


def test_run_against_brute_force(spark, sf_dir):
    """Every stage's decisions made plainly, on all rows: classes from all pairs, units in order of id, windows one by one."""
    from tessella.llm import queries, substrings

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = {r.doc_id for r in queries.op4_quality(spark, sf_dir).collect() if r.predicted}
    rows = _without_repeats(_kept_of_classes(sorted((k, t) for k, t in docs.items() if k in good)), substrings.MIN_WORDS)
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = _words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = {}
    for k, t in rows:
        w = _words(t)
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            clean[k] = t
    got = pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.text for r in got} == clean and len(got) == len(clean)
    assert len({r.mix_index for r in got}) == len(got)


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, repeated rows and ids, ties, and columns named like inner ones."""
    text = " ".join(f"Word{i} is here." for i in range(40))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (None, text, None, None, None), (2, None, "en", "a", 0), (2, "", "en", None, 0), (None, None, None, None, None), (3, text + " More of it.", "de", "b", 8), (3, "Other text of the same id.", "de", "b", 8)]
    extra = "__n long, row string, h long, doc long, id string, src string, kept string, r string"
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, "y", "z", "k", "r") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    left = len(rows)
    for name, stage in pipeline.STAGES:
        out = stage(spark, df, sf_dir)
        assert out.columns[: len(df.columns)] == df.columns, name
        left = min(left, out.count())
    near = dict(pipeline.STAGES)["near-dedup"](spark, df, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in near) == [(1, text), (2, ""), (3, "Other text of the same id.")]
    assert dict(pipeline.STAGES)["mixture"](spark, df, sf_dir).count() == len(rows)
