"""Operators of tessella.llm against brute-force versions, and on edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessella.llm")
from tessella.llm import chat, common, decontaminate, fingerprints, language, learn, licenses, mixing, nearduplicates, quality, queries, substrings, textnum, toxicity  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: null in any column, empty and wordless texts, a repeated row, ties, and clashing extra columns
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, "!!! ...", None, "a", 7),
    (4, "One two three four five six seven eight nine ten eleven twelve.", "en", "b", 62),
    (4, "One two three four five six seven eight nine ten eleven twelve.", "en", "b", 62),
    (5, "one TWO three, four five six seven eight nine ten eleven twelve", "en", "a", 63),
    (None, "Eine Zeile über Äpfel.", "de", "a", 22),
    (6, "word", "en", "b", 4),
]


def words(text):
    return WORD.findall((text or "").translate(LOW))


@pytest.fixture(scope="module")
def odd(spark):
    extra = ", row string, h long, id long, src string, found string, score double, text_1 string"
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z", 0.5, "t") for r in ODD], DOCS + extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="module")
def bench(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


# words as numbers


def test_words_agree_with_the_pattern():
    texts = ["Abc dÉf,x1 y", None, "", "--", "a" * 2000 + " b", "ABC abc"]
    w = textnum.words(pa.array(texts))
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    raw = w.data.tobytes()
    found = [raw[s : s + n].decode().translate(LOW) for s, n in zip(w.start, w.length, strict=True)]
    assert found == [x for t in texts for x in words(t)]
    assert len(set(w.hash.tolist())) == len(set(found))


def test_slices_cover_all_rows_once():
    texts = pa.array(["x" * n for n in (5, 0, 900, 3, 3)] + [None])
    parts = list(textnum.slices(texts, 10))
    assert [i for a, b in parts for i in range(a, b)] == list(range(6))


# 1 fingerprints


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_of_edited_texts(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op1_fingerprints(spark, sf_dir).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(text, reverse=True)
    off = []
    for i, k in enumerate(ids):
        t, nxt = text[k], text[ids[(i + 1) % len(ids)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(t), shingles(edited)
        off.append(abs(r.near_edited - len(a & b) / max(1, len(a | b))))
    assert np.mean(off) < 0.05


def test_fingerprints_odd_and_empty(odd, empty):
    rows = fingerprints.edited_pairs(odd).collect()
    assert len(rows) == len(ODD)
    assert len({r.fingerprint for r in rows if r.doc_id in (4, 5)}) == 1
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {""}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.edited_pairs(empty).count() == 0
    assert fingerprints.fingerprints(odd).count() == len(ODD)
    one = odd.filter("doc_id = 6")
    assert fingerprints.edited_pairs(one).first().near_next == 1.0


def test_containment_of_unequal_documents(spark):
    rng = random.Random(1)
    long = [f"w{rng.randrange(10**9)}" for _ in range(20000)]
    df = spark.createDataFrame([(" ".join(long[5000:9000]), " ".join(long))], "a string, b string")
    from pyspark.sql import functions as F

    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    r = df.select(fingerprints.containment(a, b).alias("c"), fingerprints.likeness(a, b).alias("j"), (fingerprints.merge(a, b) == b).alias("m")).first()
    assert r.c > 0.99 and abs(r.j - 0.2) < 0.03 and r.m
    # passages of 14 words: their containment in the whole is 1 or unknown, never 0; the sketch of each is never empty
    short = spark.createDataFrame([(" ".join(long[i : i + 14]), " ".join(long[:3000])) for i in range(0, 2980, 20)], "a string, b string")
    got = short.select(fingerprints.containment(a, b).alias("c"), F.size(a).alias("n")).collect()
    assert {r.c for r in got} <= {1.0, None} and np.mean([r.c is None for r in got]) < 0.15 and min(r.n for r in got) > 0


@pytest.mark.parametrize("cuts", [4, 256])
def test_next_document_with_hot_and_null_ids(spark, monkeypatch, cuts):
    monkeypatch.setattr(fingerprints, "CUTS", cuts)
    rng = random.Random(6)
    rows = [(rng.choice([None, 7, 7, rng.randrange(-50, 50), rng.randrange(10**12)]), f"text {i}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = d.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h), reverse=True)
    want = {a.text: b.text for a, b in zip(order, order[1:] + order[:1], strict=True)}
    got = fingerprints.with_next(d).collect()
    assert {r.text: r.next_text for r in got} == want and len(got) == len(rows)


# 2 language


def test_suffix_automaton_against_substrings():
    text = b" abcab abd "
    automaton = language.suffix_automaton(text)

    def known(s):
        state = 0
        for b in s:
            state = automaton[state].get(b)
            if state is None:
                return False
        return True

    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    for n in range(1, 5):
        for s in itertools.product(b"abcd ", repeat=n):
            assert known(bytes(s)) == (bytes(s) in subs)


def longest_matches(data, sample):
    """Phrases of a greedy parse of data by substrings of sample."""
    n = i = 0
    while i < len(data):
        j = i + 1
        while j <= len(data) and data[i:j] in sample:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("piece", [7, 4096])
def test_phrases_against_greedy_parse(monkeypatch, dense, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    monkeypatch.setattr(language, "TABLE_BYTES", 10**9 if dense else 0)
    samples = {"x": b" abcab abd ", "y": " ddd cab déd ".encode()}
    parser = language.Parser(samples)
    assert parser.dense == dense
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdé zq  .") for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", "abd cabd, zq ddd abcabc"]
    got = parser.entropies(textnum.words(pa.array(texts)))
    predicted = parser.predict(pa.array(texts)).to_pylist()
    for t, bits, p in zip(texts, got, predicted, strict=True):
        if words(t) and any(c.isalpha() for c in t):
            assert p["lang_pred"] == "xy"[int(bits.argmin())] and abs(p["score"] - (1 - bits.min() / bits.max())) < 1e-12
        else:
            assert p == {"lang_pred": "und", "score": 0.0}
        w = words(t)
        data = (" " + " ".join(w) + " ").encode() if w else b""
        want = [longest_matches(data, sample) * np.log2(len(sample)) / max(len(data), 1) for sample in samples.values()]
        assert np.allclose(bits, want)


def test_language_query_against_brute_force(spark, docs):
    """Every row of the query, with the same sample of training rows, parsed naively."""
    d = docs.filter("doc_id < 60").cache()
    learned = language.samples(d)
    found = {r.doc_id: r for r in language.identify(d).collect()}
    for r in d.collect():
        w = words((r.text or "").lower())
        if not w:
            assert found[r.doc_id].lang_pred == "und"
            continue
        data = (" " + " ".join(w) + " ").encode()
        bits = {k: longest_matches(data, v) * np.log2(len(v)) for k, v in sorted(learned.items())} if len(data) < 3000 else None
        if bits:
            best = min(bits, key=lambda k: (round(bits[k], 6), k))
            assert found[r.doc_id].lang_pred == best
            assert abs(found[r.doc_id].score - (1 - bits[best] / sorted(bits.values())[1])) < 1e-9


def test_language_sample_is_whole_and_bounded(spark):
    rows = [(i % 500, "abc " * 3000 + f"end{i}", "x") for i in range(1000)] + [(None, "never", "x"), (3, None, "x"), (3, "y words", "y"), (3, "other y words", "y")]
    got = language.samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got["x"].count(b" end") == language.SAMPLE_DOCS and b"never" not in got["x"]
    assert got["y"] == b" other y words "


@pytest.mark.parametrize("times", [1, 60, 1000])
def test_language_sample_with_repeated_rows(spark, times):
    """However often the rows of a language are repeated, the same of its ids are learned."""
    rows = [(k, f"le chat numéro {k} dort", "fr") for k in range(12)] + [(100 + k, f"der hund nummer {k} wacht", "de") for k in range(300)]
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = few.withColumn("n", F.explode(F.sequence(F.lit(1), F.when(F.col("lang") == "fr", times).otherwise(1)))).drop("n")
    assert language.samples(many) == language.samples(few)
    assert language.samples(few)["fr"].count(b" chat ") == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(12))


def test_null_ids_are_not_held_out(spark, docs, labels):
    more = docs.unionByName(docs.limit(20).withColumn("doc_id", F.lit(None).cast("long")))
    for found in (language.identify(more), quality.classify(more, labels), toxicity.classify(more, labels)):
        assert found.filter("held_out is null").isEmpty() and found.filter("doc_id is null and not held_out").count() == 20


def test_labelled_sample_is_bounded_for_repeated_ids(spark):
    docs = spark.createDataFrame([(k % 10, f"text {k}") for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, quality int")
    sample, counts = learn.labelled_sample(docs, labels, "quality", 5, 0, 100)
    kept = [k for k in range(10) if zlib.crc32(str(k).encode()) % 5]
    assert sorted(map(tuple, sample.collect())) == [(k, min(f"text {j}" for j in range(k, 3000, 10)), k % 2) for k in kept]
    assert sum(counts.values()) == len(kept)


def test_language_held_out(spark, docs, odd, empty):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    got = language.identify(odd).collect()
    assert len(got) == len(ODD)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert language.identify(empty).count() == 0


# 3 licenses


def test_licenses_against_brute_force(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op3_licenses(spark, sf_dir).collect()}
    for d in docs.collect():
        w, starts, base = words(d.text), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            starts += found
            base |= {label} if found else set()
        every, best = set(base), 1.0 if starts else 0.0
        for line in d.text.split("\n"):
            for label, text in licenses.TEMPLATES.items():
                t = set(text.split())
                share = len(t & set(words(line))) / len(t)
                if share >= licenses.THRESHOLD:
                    every.add(label)
                    best = max(best, share)
        r = got[d.doc_id]
        want = (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(every)), best)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want


def test_licenses_odd(spark, odd, empty):
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(odd).count() == len(ODD)
    df = spark.createDataFrame([(1, "cc by cc\nBY mit license"), (2, None)], "doc_id long, text string")
    a, b = licenses.scan(df).orderBy("doc_id").collect()
    assert (a.n_base, a.first_word, a.last_word, a.base_labels) == (3, 0, 4, "cc-by,mit")
    assert (b.n_base, b.first_word, b.labels, b.score) == (0, None, "", 0.0)


def test_licenses_wrapped_notices(spark):
    rows = [
        (1, "x y\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided"),
        (2, "This Source Code Form is subject to the terms of the Mozilla\n * Public License, v. 2.0. If a copy"),
        (3, "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published"),
        (4, "Redistribution and use in source and binary forms, with or without"),
        (5, "modification, are permitted provided"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4, 5)] == ["bsd-terms", "mpl-notice", "gpl,gpl-terms", "", ""]
    assert "bsd-terms@2+14=1.000" in got[1].blocks.split(",") and got[2].score == 1.0


# 4 quality, 7 toxicity


def auc(score, y):
    score, y = np.array(score), np.array(y)
    good, bad = score[y == 1], score[y == 0]
    return np.mean(good[:, None] > bad[None, :]) + np.mean(good[:, None] == bad[None, :]) / 2


def plain_features(text):
    """The quality features of one text, one by one."""
    t = text or ""
    w, raw = words(t), t.encode()
    n = max(len(w), 1)
    share = lambda hit: sum(hit) / max(len(raw), 1)
    upper, letters = share(65 <= b <= 90 for b in raw), share(65 <= b <= 90 or 97 <= b <= 122 for b in raw)
    often = lambda chars: np.log1p(200 * share(b in chars.encode() for b in raw))
    pairs = [w[0]] + list(zip(w, w[1:], strict=False)) if w else []
    return [
        np.log1p(len(w)), np.log(n / max(len(set(w)), 1)), np.log(n / max(len(set(pairs)), 1)), sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, upper / letters if letters else 0.0,
        often("!"), often("#$%&*@^_~<>{}[]\\=+"), often("|"), often("\n"), often("0123456789"), often(".,"), sum(len(x.encode()) for x in w) / n, share(b == 32 for b in raw), float(not w),
    ]


def test_quality_query_against_plain_features(spark, sf_dir, docs, labels):
    model = quality.fit(docs, labels)
    found = {r.doc_id: r for r in queries.op4_quality(spark, sf_dir).collect()}
    rows = docs.collect() + [r for r in docs.limit(0).collect()]
    for r in rows:
        s = float(((np.array(plain_features(r.text)) - model.mean) / model.scale) @ model.beta)
        want = 1 / (1 + np.exp(-np.clip(s - model.threshold + np.log(0.3 / 0.7), -500, 500)))
        assert found[r.doc_id].score == pytest.approx(want, abs=1e-9) and found[r.doc_id].predicted == int(found[r.doc_id].score >= 0.3)
    assert len(found) == len(rows)


def test_quality_with_contradictory_labels(spark, docs, labels):
    twice = labels.unionByName(labels.limit(30).withColumn("quality", 1 - F.col("quality")))
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, twice).collect())


def test_quality_learns_from_all_training_documents(spark):
    """More than 4,000 documents a label: coefficients against Newton's method over all pairs one by one, threshold at the exact rank."""
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(11_000):
        good = int(rng.random() < 0.5)
        n, capitals, bangs = rng.integers(3, 40), rng.random() * (0.6 if good else 1), rng.integers(0, 3 if good else 4)
        rows.append((i, " ".join(w.upper() if rng.random() < capitals else w for w in (f"w{k}" for k in rng.integers(0, 30, n))) + "!" * bangs))
        marks.append((i, good))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.fit(d, lab)
    learned = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5]
    x, y = quality.features(pa.array([rows[i][1] for i in learned])), np.array([marks[i][1] for i in learned])
    assert min((y == 0).sum(), (y == 1).sum()) > 4000
    assert model.mean == pytest.approx(x.mean(0), abs=1e-8) and model.scale == pytest.approx(x.std(0) + 1e-9, abs=1e-8)
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    good, bad, beta = z[y == 1], z[y == 0], np.zeros(z.shape[1])
    for _ in range(8):
        gradient, curve = np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
        for part in np.array_split(good, 20):
            p = 1 / (1 + np.exp(part @ beta[:, None] - (bad @ beta)[None, :]))
            q = p * (1 - p)
            gradient += p.sum(1) @ part - p.sum(0) @ bad
            curve += (part * q.sum(1)[:, None]).T @ part + (bad * q.sum(0)[:, None]).T @ bad - part.T @ q @ bad - (part.T @ q @ bad).T
        pairs = len(good) * len(bad)
        beta += np.linalg.solve(curve / pairs + np.eye(len(beta)) / 800, gradient / pairs - beta / 800)
    assert model.beta == pytest.approx(beta, abs=1e-4)
    s = np.sort(z @ beta)
    n0 = int((y == 0).sum())
    assert s[n0 - 1] - 1e-3 < model.threshold < s[n0] + 1e-3
    predicted = {r.doc_id: r.predicted for r in quality.classify(d, lab).collect()}
    assert sum(1 - predicted[i] for i in learned) == n0


def test_value_at_a_rank(spark):
    values = [0.5] * 5 + [1e-300, 2e-300, 3.0, 3.0 + 1e-12, -7.0, 1e9]
    frame = spark.createDataFrame([(v,) for v in values], "s double").repartition(3)
    order = sorted(values)
    for rank, value in enumerate(order):
        assert learn.at_rank(frame, rank) == (value, min((v for v in order if v > value), default=value))


def test_quality_held_out(docs, labels, odd, empty, spark):
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.classify(docs, labels).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert auc(*zip(*held, strict=True)) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.classify(odd, labels).count() == len(ODD)
    assert quality.classify(empty, labels).count() == 0
    none = labels.limit(0)
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.keep_good(odd, none).columns == odd.columns


def test_toxicity(spark, docs, labels, odd, empty):
    rows = toxicity.classify(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify(odd, labels).count() == len(ODD)
    assert toxicity.classify(empty, labels).count() == 0
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}


@pytest.fixture(scope="module")
def insults(spark):
    """12,000 texts of common words; a third toxic, with one passage of insults each, and a little more of some common words."""
    rng = random.Random(2)
    common, weight = [f"w{i}" for i in range(400)], [1 / (i + 1) for i in range(400)]
    rows, marks = [], []
    for i in range(12_000):
        w = rng.choices(common, weight, k=60)
        toxic = i % 3 == 0
        if toxic:
            at = rng.randrange(10, 45)
            w[at : at + 6] = [rng.choice(["vile", f"gruesomely{rng.randrange(10**6)}", "w7"]) for _ in range(5)] + ["vile"]
            w[rng.randrange(8)] = f"w{rng.randrange(5)}"
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(toxic)))
    marks += [(5, 1, 1), (6, 1, 0)]  # contradictory labels
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("size", [300, 1000, 4000])
def test_toxicity_at_every_sample_size(insults, size):
    d, lab = insults
    model = toxicity.fit(d, lab, size)
    assert 2 <= (model.odds > 0).sum() < 60 and model.lam > 0.1
    scored = d.select("doc_id", "text", toxicity.score(F.col("text"), model).alias("s")).filter(common.fold(F.col("doc_id"), 3) == 1).collect()
    toxic, marked = np.array([r.doc_id % 3 == 0 for r in scored]), np.array([r.s.score >= toxicity.CUT for r in scored])
    assert marked[toxic].mean() > 0.97 and marked[~toxic].mean() < 0.01
    # passages, not whole texts
    inside = []
    for r in scored[:300]:
        w = r.text.split()
        bad = {i for i, x in enumerate(w) if x == "vile" or x.startswith("gruesomely")}
        spans = [tuple(map(int, x.split("-"))) for x in r.s.segments.split(",") if x]
        assert all(any(a <= i < b for i in bad) for a, b in spans)
        if bad:
            inside.append(len(bad & {i for a, b in spans for i in range(a, b)}) / len(bad))
            assert sum(b - a for a, b in spans) <= 20
    assert np.mean(inside) > 0.95


def plain_segments(s):
    """(first, end) of the best segment, and of the best ones left and right of it."""
    def split(a, b):
        best = max(((sum(s[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), key=lambda x: (round(x[0], 9), -(x[2] - x[1]), -x[1]), default=None)
        return [] if not best or best[0] <= 1e-12 else [*split(a, best[1]), best, *split(best[2], b)]

    return split(0, len(s))


def test_toxicity_query_against_plain_version(spark, insults):
    """The whole operator once more with strings, dictionaries and plain loops."""
    few = insults[0].filter("doc_id < 420").collect()
    rows = [tuple(r) for r in few] + [(1000, None), (1001, ""), (1002, few[0].text), (1002, "zz " + few[0].text), (None, few[1].text)]
    marks = [(r.doc_id, 1, int(r.doc_id % 3 == 0)) for r in few] + [(5, 1, 1), (6, 1, 0), (1002, 1, None), (1003, 0, 1)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")

    side = {}
    for i, _, t in marks:
        if t is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            side.setdefault(i, set()).add(t)
    side = {i: t.pop() for i, t in side.items() if len(t) == 1}
    text_of = {}
    for i, t in rows:
        if i in side:
            text_of[i] = min(text_of.get(i, t or ""), t or "")
    sample = sorted({(t, side[i]) for i, t in text_of.items()})

    def tokens(word):
        b = word.encode()
        return [b, *(b[:k] for k in toxicity.PREFIXES if len(b) > k)]

    places = {(p, w, n, label) for t, label in sample for p, w, n in zip([None, *words(t)], words(t), [*words(t)[1:], None])}
    size = [sum(x[3] == label for x in places) for label in (0, 1)]
    count = {}
    for _, w, _, label in places:
        for token in tokens(w):
            count.setdefault(token, [0, 0])[label] += 1
    scored = {}
    for token, c in count.items():
        if max(c) >= toxicity.LEAST_PLACES:
            a = [c[k] + sum(c) * toxicity.PRIOR / sum(size) * size[k] for k in (0, 1)]
            odds = [np.log(a[k] / (size[k] * (1 + toxicity.PRIOR) - a[k])) for k in (0, 1)]
            scored[token] = odds[1] - odds[0], (odds[1] - odds[0]) / np.sqrt(1 / a[0] + 1 / a[1])
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - toxicity.FAMILY / 2 / len(scored))
    odds = {k: o for k, (o, v) in scored.items() if (v >= z and o >= toxicity.LEAST_ODDS) or v <= -z}
    assert any(o > 0 for o in odds.values())

    def telling(word):
        best = 0.0
        for token in tokens(word):
            if abs(odds.get(token, 0.0)) > abs(best):
                best = odds[token]
        return best

    clean = [round(telling(w), 2) + 0.0 for t, label in sample if label == 0 for w in words(t)]
    least = min(o for o in odds.values() if o > 0)
    seen = np.array([*clean, least])
    drift = max(toxicity.DRIFT, 2 * seen.mean())
    low, high = 1e-9, 1.0
    while np.exp(high * (seen - drift)).mean() < 1:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.exp(mid * (seen - drift)).mean() < 1 else (low, mid)
    lam = (low + high) / 2
    found = {t: plain_segments([telling(w) - drift for w in words(t)]) for t in {t for t, _ in sample} | {t or "" for _, t in rows}}
    k = max(1, sum(len(found[t]) for t, label in sample if label == 0)) / (len(seen) * np.exp(-lam * max(least - drift, 0.0)))

    def log_e(t):
        return [np.log(k) + np.log(len(words(t))) - lam * x[0] for x in found[t]]

    def stats(t):
        e = log_e(t)
        return [1.0, min(max(0.0, -min(e)), toxicity.MOST), np.log1p(sum(x <= np.log(toxicity.SIGNIFICANT) for x in e))] if e else [1.0, 0.0, 0.0]

    x, y = np.array([stats(t) for t, _ in sample]), np.array([label for _, label in sample])
    known = [sum(v == label for v in side.values()) for label in (0, 1)]
    weight = np.array([known[v] / (y == v).sum() for v in y])
    weight = weight / weight.mean()
    beta = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (weight * (y - p)) - 0.1 * beta)
    want = []
    for i, t in rows:
        t = t or ""
        score = 1 / (1 + np.exp(-np.array(stats(t)) @ beta))
        spans = ",".join(f"{a}-{b}" for e, (_, a, b) in zip(log_e(t), found[t]) if e <= np.log(toxicity.SIGNIFICANT))
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, round(float(score), 5), int(score >= 0.7), spans))
    got = [(r.doc_id, r.held_out, round(r.score, 5), r.predicted, r.segments) for r in toxicity.classify(docs, labels).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_maximal_segments_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 40)
        s = [rng.choice([0.313, 1.0371, 0.0577]) if rng.random() < 0.2 else -toxicity.DRIFT for _ in range(n)]
        at = [i for i, x in enumerate(s) if x > 0]
        total = np.concatenate([[0.0], np.cumsum(s)])
        got = toxicity.maximal_segments(at, total[at].tolist(), total[np.array(at, int) + 1].tolist())

        def split(a, b):  # the best segment, then the same left and right of it
            best = max(((sum(s[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), key=lambda x: (round(x[0], 9), -(x[2] - x[1]), -x[1]), default=None)
            if not best or best[0] <= 1e-12:
                return []
            return split(a, best[1]) + [best] + split(best[2], b)

        want = split(0, n)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert np.allclose([x for x, _, _ in got], [x for x, _, _ in want])


# 5 decontamination


def test_contamination_against_brute_force(spark, sf_dir, docs, bench):
    windows = {}
    for b in bench.collect():
        w = words(b.text)
        for i in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(b.item_id))
    got = {r.doc_id: r for r in queries.op5_decontaminate(spark, sf_dir).collect()}
    for d in docs.collect():
        w, hit, items = words(d.text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[key]
        r = got[d.doc_id]
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(items), digest, bool(hit))


def test_contamination_odd(spark, odd, empty, monkeypatch):
    items = spark.createDataFrame([(7, "two three four"), (8, None), (9, "!"), (7, "two three four"), (10, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 1):  # one block, and a block an item
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = decontaminate.contamination(odd, items).collect()
        assert len(got) == len(ODD)
        assert {(r.n_hit, r.n_items) for r in got if r.doc_id in (4, 5)} == {(11, 2)}
        assert not any(r.contaminated for r in got if r.doc_id not in (4, 5))
        assert decontaminate.clean(odd, items).count() == len(ODD) - 3
    assert decontaminate.contamination(empty, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, items.limit(0)).collect())
    assert decontaminate.clean(odd, items).columns == odd.columns


def test_postings_hold_every_word(spark, odd):
    """The stored index gives back the words of every row, in order."""
    got = []
    for r in decontaminate.index(odd).collect():
        s = decontaminate.Segment(np.array(r.terms, np.int64).view(np.uint64), np.array(r.sizes, int), np.array(r.places, int), np.array(r.counts, int))
        at = dict(zip(s.places.tolist(), np.repeat(s.terms, s.sizes).tolist(), strict=True))
        got += [(d, [at[b + i] for i in range(n)]) for d, b, n in zip(r.doc, s.base.tolist(), r.counts, strict=True)]
    want = [(r[0], textnum.word_hash(r[1] or "").tolist()) for r in ODD]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_contamination_of_equal_ids_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(textnum, "SLICE_BYTES", 40)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1)
    rows = [(1, "a b c d"), (1, "x y z"), (None, "a b c"), (None, "q"), (2, "c a b c x y"), (2, "c a b c x y")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "x y"), (3, "nothing of it")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(d, items).collect())
    assert got == [(0, 1, 0, 0), (0, 3, 3, 1), (1, 3, 2, 1), (1, 4, 3, 1), (2, 6, 5, 2), (2, 6, 5, 2)]
    assert [(r.doc_id, r.text) for r in decontaminate.clean(d, items).collect()] == [(None, "q")]


def test_blocks_are_counted_in_words(spark, monkeypatch):
    """Also where words are not parted by blanks."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    items = spark.createDataFrame([(k, sep.join("abcde")) for k, sep in enumerate(("\n", ".", " ", "\t", "--", "\n"))] + [(9, None)], "item_id long, text string")
    assert len(list(decontaminate._blocks(items))) == 3
    assert len(list(decontaminate._blocks(items.limit(0)))) == 1


def test_proximity(spark):
    item = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    texts = [(1, "a b c x d e f g h i j"), (2, "a b c d e f g h i"), (3, "j a b c d e f g h i j")]
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), item).collect()}
    assert got == {1: (0, 1), 2: (0, 0), 3: (1, 1)}


# 6 substrings


def brute_dedup(rows, bar):
    """rows (doc_id, text): marked units of each document, as sets of unit numbers."""
    units = {}
    for d, text in rows:
        parts = [tuple(words(p)) for p in re.split(r"\n|(?<=[.!?])[ \t]", text or "")]
        units[d] = [p for p in parts if p]
    keeper = {}
    for d in sorted(units):
        for p in units[d]:
            keeper.setdefault(p, d)
    out = {}
    for d, ps in units.items():
        seen, flags = set(), []
        for p in ps:
            flags.append(keeper[p] < d or p in seen)
            seen.add(p)
        gone, i = 0, 0
        for flag, run in itertools.groupby(flags):
            n = len(list(run))
            if flag and sum(len(p) for p in ps[i : i + n]) >= bar:
                gone += n
            i += n
        out[d] = (len(ps), gone)
    return out


@pytest.mark.parametrize("bar", [1, substrings.MIN_WORDS])
def test_substrings_against_brute_force(docs, bar):
    want = brute_dedup([(r.doc_id, r.text) for r in docs.collect()], bar)
    got = substrings.dedup_report(docs, bar).collect()
    assert {r.doc_id: (r.n_units, r.n_removed) for r in got} == want
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        spans = [tuple(map(int, s.split("-"))) for s in r.spans.split(",") if s]
        rest, at = "", 0
        for a, b in spans:
            rest += text[r.doc_id][at:a]
            at = b
        assert rest + text[r.doc_id][at:] == r.text and r.removed_chars == sum(b - a for a, b in spans)


def test_substrings_odd(spark, odd, empty):
    out = substrings.dedup(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((str(r[0]), str(r[1])) for r in ODD)
    assert substrings.dedup(empty).count() == 0
    passage = " ".join(f"p{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(2, f"Own words here. {passage} End."), (1, f"Start.\n{passage}\nStop."), (3, passage)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substrings.dedup(df).collect()}
    assert got == {1: f"Start.\n{passage}\nStop.", 2: "Own words here. End.", 3: ""}


def test_substrings_marks_belong_to_one_row(spark):
    line = lambda name: " ".join(f"{name}{i}" for i in range(30)) + "."
    rows = [(1, line("p")), (None, f"{line('p')}\n{line('q')}"), (None, f"{line('u')}\n{line('v')}"), (2, f"{line('p')}\nx"), (2, f"{line('w')}\ny"), (None, f"{line('z')}\na"), (None, f"{line('z')}\nb")]
    got = sorted(r.text.replace("\n", " ").strip() for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    z = [g for g in got if g.split()[-1] in "ab"]
    assert sorted(len(g.split()) for g in z) == [1, 31]
    assert [g for g in got if g not in z] == sorted([line("p"), line("q"), f"{line('u')} {line('v')}", "x", f"{line('w')} y"])


# 8 chat


def test_chat_keeps_rows_of_equal_turn(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "c"), (1, None, "user", "d"), (1, None, "assistant", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = chat.digests(chat.format_events(chat.conversation_events(df))).collect()
    turns = "user\na\nuser\na\nassistant\nb\nassistant\nc\nassistant\ne\nuser\nd\n"
    assert (got.n_turns, got.loss_chars, got.turns_sha256) == (6, 3, hashlib.sha256(turns.encode()).hexdigest())



def test_chat_ignores_other_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, None, None, "x")], "conv_id long, turn long, role string, text string")
    clashing = rows.selectExpr("*", "'a' AS seq", "'b' AS kind", "1 AS cut", "2 AS log", "3 AS turns", "4 AS loss", "5 AS formatted", "6 AS said")
    form = lambda r: sorted(map(tuple, chat.digests(chat.format_events(chat.conversation_events(r))).collect()))
    assert form(clashing) == form(rows) and [r[:2] for r in form(rows)] == [(1, 2), (2, 1)]


def test_chat_folds_events(spark):
    events = spark.createDataFrame(
        [
            (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "he"), (1, 4, 1, "delta", None, "llo"),
            (1, 5, 2, "message", "user", "gone"), (1, 6, 1, "regenerate", None, "x"), (1, 7, 1, "delta", None, "y"), (1, 8, 0, "edit", None, "hey"),
            (2, None, 0, None, None, None), (None, 1, 0, "message", "user", "n"),
        ],
        "conv_id long, seq long, turn long, kind string, role string, text string",
    )
    got = {r.conv_id: r for r in chat.format_events(events).collect()}
    assert got[1].formatted == "<|im_start|>user\nhey<|im_end|>\n<|im_start|>assistant\nxy<|im_end|>\n"
    assert [got[1].formatted[s.start - 1 : s.start - 1 + s.length] for s in got[1].loss_spans] == ["xy"]
    assert got[2].formatted == "<|im_start|>\n<|im_end|>\n" and None in got
    assert chat.format_events(events.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_chat_round_trip(spark, seed):
    rng = random.Random(seed)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "|", "<", "\n", "\\n", "é", "a", "assistant", "\\\\|", "$1"]
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb", "x\\n", "<|"]), "".join(rng.choices(bits, k=rng.randrange(8)))) for c in range(30) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_events(chat.conversation_events(df))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse(formatted).collect()}
    assert got == {c: [(r, t) for k, _, r, t in rows if k == c] for c in range(30)}
    for r in chat.digests(formatted).collect():
        loss = "".join(t for k, _, role, t in rows if k == r.conv_id and role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# 9 near-duplicates


def test_alignment_is_exact():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    a = nearduplicates.labelled_kmers(base)
    assert nearduplicates.aligned_similarity(a, a) == 1.0
    edited = base.copy()
    edited[100] = 7
    b = nearduplicates.labelled_kmers(np.insert(edited, 200, [1, 2, 3]).astype(np.uint64))
    shared = len(set(a.tolist()) & set(b.tolist()))
    assert nearduplicates.aligned_similarity(a, b) == pytest.approx(shared / (len(a) + len(b) - shared))
    swapped = nearduplicates.labelled_kmers(np.concatenate([base[150:], base[:150]]))
    assert nearduplicates.aligned_similarity(a, swapped) < 0.8  # the same shingles, in another order


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for group in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 60) + 1)):
                p = rng.randrange(len(w))
                w[p : p + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"]
            rows.append((n, " ".join(w)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in nearduplicates.classes(df).collect()}
    s = {d: shingles(t) for d, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(s, 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8]
    assert len(pairs) > 50
    recall = np.mean([got[a].class_id == got[b].class_id for a, b in pairs])
    assert recall >= 0.99
    links = {a: set() for a in s}
    for a, b in itertools.combinations(s, 2):
        if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.79:
            links[a].add(b), links[b].add(a)
    for a, b in itertools.combinations(s, 2):
        if got[a].class_id == got[b].class_id:  # joined only by links
            seen, todo = {a}, [a]
            while todo:
                todo += (new := links[todo.pop()] - seen)
                seen |= new
            assert b in seen


def test_near_duplicates_copies_of_copies(spark):
    """A crowd around one text whose members are unlike it, but each has a twin."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(40):
        w = list(base)
        for p in rng.sample(range(300), 14):
            w[p] = f"e{i}x{p}"
        twin = list(w)
        twin[rng.randrange(300)] = f"t{i}"
        rows += [(2 * i + 1, " ".join(w)), (2 * i + 2, " ".join(twin))]
    s = {d: shingles(t) for d, t in rows}
    assert all(len(s[2 * i + 1] & s[0]) / len(s[2 * i + 1] | s[0]) < 0.8 for i in range(40))
    got = {r.doc_id: r for r in nearduplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[2 * i + 2].class_id == 2 * i + 1 for i in range(40)]) > 0.95
    assert got[0].class_id == 0 and got[0].n_links == 0


def one_group(monkeypatch):
    monkeypatch.setattr(nearduplicates, "band_keys", lambda s, rows, count: F.array(*(F.lit(k).cast("long") for k in range(count))))


def test_near_duplicates_unlike_members_elect_leaders(spark, monkeypatch):
    one_group(monkeypatch)
    rng = random.Random(6)
    bases = [[f"b{g}x{i}" for i in range(160)] for g in range(20)]
    rows = []
    for i in range(60):
        w = list(bases[i % 20])
        w[rng.randrange(160)] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = nearduplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.class_id == r.doc_id % 20 for r in got)


def test_near_duplicates_chain_in_one_group(spark, monkeypatch):
    """Each text is like the next one only; all share all keys, led by the first."""
    one_group(monkeypatch)
    monkeypatch.setattr(nearduplicates, "COMMON", 1)
    monkeypatch.setattr(nearduplicates, "COUNTED", 1)
    monkeypatch.setattr(nearduplicates, "BATCH", 2)
    w, rows = [f"b{i}" for i in range(200)], []
    for i in range(12):
        for p in range(5):
            w[13 * i + 2 * p] = f"e{i}x{p}"
        rows.append((i, " ".join(w)))
    s = [shingles(t) for _, t in rows]
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.8
    assert all(alike(a, b) for a, b in zip(s, s[1:])) and not any(alike(a, b) for a, b in zip(s, s[2:]))
    got = nearduplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 12 and all(r.class_id == 0 for r in got)


def test_near_duplicates_odd(spark, odd, empty):
    rows = nearduplicates.classes(odd).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r.class_id for r in rows}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, None: None}
    kept = nearduplicates.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "None"]
    assert nearduplicates.classes(empty).count() == 0 and nearduplicates.keep_one(empty).count() == 0


def test_near_duplicates_of_equal_or_null_ids(spark):
    """Different texts under one id stay apart; copies go, with an id or without."""
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("b")), (2, text("b")), (None, text("c")), (None, text("d")), (None, text("d") + " end"), (3, text("c") + " end"), (4, text("e")), (4, text("e"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in nearduplicates.classes(df).collect())
    assert got == [(0, 0), (0, 0), (0, 3), (1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (4, 4)]
    kept = sorted((r.doc_id or 0, r.text[0]) for r in nearduplicates.keep_one(df).collect())
    assert kept == [(0, "d"), (1, "a"), (1, "b"), (3, "c"), (4, "e")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)]
    got = {r.id: r.label for r in nearduplicates.components(spark.createDataFrame(chain, "lead long, id long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# 10 mixing


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 0.61, "b": 0.27, "c": 0.119, "d": 0.001}, {"a": 5}])
def test_schedule_deviates_less_than_a_block(weights):
    share = mixing.shares(weights)
    period = sum(share.values())
    slots = mixing.schedule(share)
    assert sorted(t for s in slots.values() for t in s) == list(range(period))
    for k, s in slots.items():
        had = np.searchsorted(s, np.arange(1, period + 1), "left")
        assert np.abs(had - np.arange(1, period + 1) * share[k] / period).max() < 1


def test_mixture_keeps_to_the_target_weights():
    blocks = {"big": 12500} | {f"s{i}": 1316 for i in range(19)} | {"rare": 40}
    weights = {k: n**0.5 for k, n in blocks.items()} | {"rare": 0.01}
    slots, horizon = mixing.mixture(weights, blocks)
    assert horizon > 10000 and sorted(t for s in slots.values() for t in s) == list(range(sum(blocks.values())))
    t = np.arange(1, horizon + 1)
    for k, s in slots.items():
        assert len(s) == blocks[k]
        assert np.abs(np.searchsorted(s, t, "left") - t * (weights[k] / sum(weights.values()))).max() < 1


@pytest.mark.parametrize("seed", range(12))
def test_stretches_are_the_schedule(spark, monkeypatch, seed):
    """However the schedule is cut into stretches, the tasks make the slots of the schedule in one piece, which is EDF over the windows of the exact weights."""
    from fractions import Fraction

    rng = random.Random(seed)
    weights = {f"s{k}": rng.choice((1, 2, 0.1, rng.random(), 10 * rng.random())) for k in range(rng.randint(1, 9))}
    blocks = {k: rng.randint(1, 60) for k in weights}
    plain, horizon = {k: [] for k in weights}, None
    start, active = 0, sorted(weights)
    while active:
        total, t, own = sum(Fraction(weights[k]) for k in active), 0, {k: len(plain[k]) for k in active}
        while True:
            due = {k: (-(-(len(plain[k]) - own[k] + 1) * total // Fraction(weights[k])), k) for k in active if (len(plain[k]) - own[k]) * total // Fraction(weights[k]) <= t}
            k = min(due, key=due.get)
            if len(plain[k]) == blocks[k]:
                break
            plain[k].append(start + t)
            t += 1
        start += t
        horizon = start if horizon is None else horizon
        active = [k for k in active if len(plain[k]) < blocks[k]]
    for every in (1, 7, 1000):
        monkeypatch.setattr(mixing, "STRETCH", every)
        assert mixing.mixture(weights, blocks) == (plain, horizon)
    names, whole = mixing.whole_weights(weights)
    found, _ = mixing.stretches(whole, [blocks[k] for k in names], 7)
    assert all(s.steps <= 7 for s in found)
    number_of = {k: 3 * i + 1 for i, k in enumerate(names)}
    made = {(r.block_key >> mixing.NUMBER_BITS, r.block_key & (1 << mixing.NUMBER_BITS) - 1): r.slot for r in mixing.slot_table(spark, names, whole, found, number_of).collect()}
    assert made == {(number_of[k], i): slot for k in names for i, slot in enumerate(plain[k])}


def test_release_removes_stored_tables(spark):
    from pathlib import Path

    from tessella.llm import common

    first = common.written(spark.range(3))
    mark = common.n_stored()
    second = common.written(spark.range(4))
    paths = [Path(df.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent for df in (first, second)]
    assert common.release(spark, mark) == 1 and not paths[1].exists() and first.count() == 3
    assert common.n_stored() == mark


def test_mixing_query_keeps_to_the_targets(spark, sf_dir, docs):
    """The whole query: every document once, and each source's blocks within one of its weight times the slots so far."""
    rows = queries.op10_mixing(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect()) and len({r.mix_index for r in rows}) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    total = sum(n**0.5 for n in sizes.values())
    of = {r.mix_slot: r.source for r in rows if r.in_target}
    assert sorted(of) == list(range(len(of))) and of
    for source, n in sizes.items():
        had = np.cumsum([of[t] == source for t in range(len(of))])
        assert np.abs(had - np.arange(1, len(of) + 1) * n**0.5 / total).max() < 1


def test_mixing_numbers_every_document(spark, odd, empty):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 7}", 2) for i in range(9000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, {"hot": 2, "s0": 1, "s3": 1, "s6": 1}, block=4).orderBy("mix_index").collect()
    assert sorted(r.doc_id for r in got) == list(range(9000)) and len({r.mix_index for r in got}) == 9000
    share = mixing.shares({"hot": 2, "s0": 1, "s3": 1, "s6": 1})
    target = [r for r in got if r.in_target]
    slots = max(r.mix_slot for r in target) + 1
    for source, weight in (("hot", share["=hot"] if "=hot" in share else share["hot"]), ("s0", share["s0"])):
        n = len({r.mix_slot for r in target if r.source == source})
        assert abs(n - slots * weight / sum(share.values())) < 1
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0
    clash = mixing.mix(df.withColumn("__n", F.lit("mine")).withColumn("n", F.lit(1)).withColumn("slot", F.lit(2)))
    assert clash.select("__n", "n", "slot").distinct().count() == 1
    again = mixing.mix(df, {"hot": 2, "s0": 1, "s3": 1, "s6": 1}, block=4).orderBy("mix_index").collect()
    assert [r.doc_id for r in again] == [r.doc_id for r in got]
