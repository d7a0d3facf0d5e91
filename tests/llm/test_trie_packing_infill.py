"""Conversation tries, packing and fill-in-middle against plain versions, and on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("tessella.llm")
from tessella.llm import infill, packing, queries, trie  # noqa: E402

CONVERSATIONS = "conv_id long, turn long, role string, text string"
TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def plain_trie(rows):
    """The contract, word by word: every node by its whole sequence of turns."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            text, role = text or "", role or ""
            own[conv_id].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], text))
    turns = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100
        rebuilt[c] = turns.get(c - base, [])[:h] + turns[c][h:]
    nodes = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        ends = sorted(c for c in members if len(rebuilt[c]) == len(path))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), len(childless),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(spark, rows):
    found = trie.report(spark.createDataFrame(rows, CONVERSATIONS)).select(*COLUMNS)
    assert found.dtypes == [(c, "bigint") for c in COLUMNS[:-1]] + [("ends_sha256", "string")]
    return sorted(map(tuple, found.collect()), key=str)


def conversations(seed, n=60, most=9):
    """Few texts and many families, so that prefixes are shared inside and between them."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample([*range(0, 500), *range(-150, 0)], n):
        for turn in range(rng.randint(1, most)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["a", "bb", "ccc é"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "longest"), [(1, 1024), (2, 6), (3, 7)])
def test_trie_against_plain_version(spark, monkeypatch, seed, longest):
    """Also with a low bound beyond which a conversation is a family of its own."""
    monkeypatch.setattr(trie, "LONG", longest)
    rows = conversations(seed, most=13)
    rows += [(c, t, "user", "a") for c, n in ((1101, 7), (1102, 12), (1103, 7), (1104, 11), (1105, 7)) for t in range(n)]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_deep_and_shared(spark):
    """Equal chains of 70 turns in three families: the corrections climb the whole chain."""
    rows = [(c, t, "user", f"t{t}") for c in (7, 307, 308, 501) for t in range(70)] + [(c, t, "user", "") for c in (300, 0) for t in range(6)]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_odd_and_empty(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "user", "y"), (101, 0, "user", "only"), (None, 0, "user", "lost"),
        (2**62, 5, "", ""), (205, 1, "a", "z" * 50_000), (200, 1, "a", "z"), (200, None, "b", "first"),
    ]
    assert trie_rows(spark, rows) == plain_trie(rows)
    clashing = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], CONVERSATIONS + ", pos long, base long, digest string")
    assert sorted(map(tuple, trie.report(clashing).select(*COLUMNS).collect()), key=str) == plain_trie(rows)
    assert trie_rows(spark, []) == []


def test_trie_query_and_texts_of_nodes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plain = [tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op11_prefixtrie(spark, sf_dir).select(*COLUMNS).collect()), key=str) == plain_trie(plain)
    nodes = trie.build(rows)
    named = nodes.join(trie.rebuilt(rows), ["conv_id", "depth"]).select("key", "parent_key", "role", "text").collect()
    assert len(named) == nodes.filter("depth > 0").count()
    keys = {trie.next_key((int(r.parent_key[:16], 16) - (int(r.parent_key[0], 16) >= 8) * 2**64, int(r.parent_key[16:], 16) - (int(r.parent_key[16], 16) >= 8) * 2**64), hashlib.sha256(f"{len(r.role)}:{r.role}{r.text}".encode()).digest()[:16]): r.key for r in named}
    assert all("".join(f"{x % 2**64:016X}" for x in k) == v for k, v in keys.items())


ODD_TEXTS = [None, "", " ", "\n\n", "one  two\nthree's don't", "end<|endoftext|>of <|startoftext|> text <|", "É é  x y\x1cz\x85w", "ΑΣ ΑΣΑ ǅ İ", "123 4,5..!! ?", "日本語 テスト 😀😀", "word " * 5000, "x" * 9000, "a\tb\r\nc", "İstanbul. İ! J\u030c, j\u030c ﬁn Straße; 한국. \u1112\u1161\u11ab ª º. A. b.. c?! .. \u0301a e\u0301. ʰa Ω. \u10d0\u1c90"]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("remembered", [1_000_000, 40])
def test_pieces_are_the_tokenizers_ids(spark, monkeypatch, sf_dir, remembered):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD_TEXTS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = defaultdict(list)
    for r in packing.pieces(docs, TOKENIZER).collect():
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
        found[r.doc_id].append(r)
    plain = tokenizer()
    for k, text in enumerate(texts):
        cut = sorted(found[k], key=lambda r: r.piece)
        assert [x for r in cut for x in r.ids] == plain.encode(text or "", add_special_tokens=False).ids + [0]
        assert [r.piece for r in cut] == list(range(len(cut))) and [r.start for r in cut] == [2048 * i for i in range(len(cut))]
        assert all(r.length == 2048 for r in cut[:-1])


def test_pieces_of_a_tokenizer_that_keeps_blanks(spark):
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    for r in packing.pieces(docs, path, capacity=100_000, blanks=False).collect():
        assert r.ids == plain.encode(ODD_TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_best_fit_against_a_list_of_sequences(limit):
    rng = random.Random(limit)
    sequences, plain, made = packing.Sequences(20, limit), [], 0  # plain: number and free room of open sequences
    for _ in range(2000):
        length = rng.randint(1, 20)
        fits = [x for x in plain if x[1] >= length]
        number, offset = sequences.place(length)
        if fits:
            least = min(room for _, room in fits)
            assert offset == 20 - least and [number, least] in plain
            plain.remove([number, least])
            left = least - length
        else:
            assert (number, offset) == (made, 0)
            made += 1
            if len(plain) == limit:
                fullest = min(room for _, room in plain)
                closed = [x for x in plain if x[1] == fullest][-1]  # the one opened last, as in a stack
                plain.remove(closed)
            left = 20 - length
        if left:
            plain.append([number, left])


def test_packing_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op12_packing(spark, sf_dir).collect()
    assert sorted({r.doc_id for r in rows}) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= 1.01 * -(-sum(r.length for r in rows) // 2048) + 1
    again = queries.op12_packing(spark, sf_dir).collect()
    assert sorted(rows) == sorted(again)


def test_packing_odd_rows_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 10)
    rows = [(None if k % 3 == 0 else 1, t) for k, t in enumerate(ODD_TEXTS)] + [(7, "same text")] * 40
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, length long, piece string")
    packed = packing.pack(packing.pieces(docs, TOKENIZER), len(rows))
    found = packed.collect()
    assert len(found) == sum(max(1, -(-(len(tokenizer().encode(t or "", add_special_tokens=False).ids) + 1) // 2048)) for _, t in rows)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in found)
    assert sum(map(len, whole.values())) == sum(r.length for r in found)
    assert packing.plan(docs.limit(0), TOKENIZER).collect() == []


def plain_infill(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
    out = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if h4 % 100 < 20 else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return doc_id, n, "spm" if h4 % 100 < 20 else "psm", a, b - a, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_infill_query_against_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op13_infill(spark, sf_dir).collect())) == sorted(plain_infill(*r) for r in docs)


def test_infill_odd_and_empty(spark):
    texts = [None, "", "<P>", "a<S>b", "<<<M>", "<", "S>", "<P", "é😀\n\r\n", "x" * 300_000, "tab\t<M", "0"]
    rows = [(k, t) for k in range(40) for t in texts] + [(None, "no id"), (None, None), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, infill.digests(docs).collect()), key=key) == sorted((plain_infill(*r) for r in rows), key=key)
    clashing = infill.transform(docs.limit(5).selectExpr("*", "1 AS n", "'z' AS fim", "2 AS row", "'q' AS output"))
    assert clashing.columns == ["doc_id", "text", "fim", "row", "form", "n", "prefix_chars", "middle_chars", "output", "output_sha256"]
    assert len(clashing.collect()) == 5
    assert infill.digests(docs.limit(0)).collect() == []


@pytest.mark.parametrize("unit", [r"\X", r"\s*\S+\s*|\s+"])
def test_infill_of_other_units(spark, unit):
    """Cuts fall between units only, and the texts come back."""
    import regex
    from pyspark.sql import functions as F

    texts = ["éé 👩‍👩‍👧 flag 🇩🇪🇫🇷\r\n" * 3, "some plain words here", "  lead"]
    docs = spark.createDataFrame([(k, t) for k in range(20) for t in texts], "doc_id long, text string")
    for r in infill.transform(docs, unit=unit).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect():
        ends = [0, *(m.end() for m in regex.finditer(unit, r.text))]
        assert r.back == r.text and r.n == len(ends) - 1
        if r.form != "plain":
            assert r.prefix_chars in ends and r.prefix_chars + r.middle_chars in ends
