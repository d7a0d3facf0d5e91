"""Texts longer than what is handled at once, whole through the operators."""

import hashlib
import re
import zlib

import pytest

pytest.importorskip("tessella.llm")
from tessella.llm import decontaminate, infill, language, licenses, packing, textnum  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICE = "released under the mit license"
LONG = " ".join(f"word{k % 977} und ähnlich" for k in range(9_000)) + f"\n{NOTICE} " + "tail\n" * 3000 + "gnu general public license"


@pytest.fixture
def docs(spark, monkeypatch):
    monkeypatch.setattr(textnum, "SLICE_BYTES", 20_000)
    rows = [(1, LONG, "de"), (2, "short words here", "en"), (4, "die kurze zeile und ähnlich word3", "de"), (5, "", "en"), (8, "some english words", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_a_long_text(docs):
    assert len(LONG) > 9 * 20_000 and len(LONG) > language.PIECE
    parser = language.Parser(language.samples(docs))
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    assert found[1].lang_pred == "de" and 0 < found[1].score <= 1
    again = parser.predict(__import__("pyarrow").array([LONG, "short words here"])).to_pylist()
    assert (again[0]["lang_pred"], again[0]["score"]) == (found[1].lang_pred, found[1].score)


def test_notices_in_a_long_text(docs):
    words = WORD.findall(LONG.lower())
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}[1]
    last = len(words) - 4
    assert (found.n_words, found.n_base, found.last_word, found.base_labels) == (len(words), 2, last, "gpl,mit")
    assert words[found.first_word : found.first_word + 2] == ["mit", "license"]


def test_passages_of_a_long_text(spark, docs):
    words = WORD.findall(LONG.lower())
    items = spark.createDataFrame([(7, " ".join(words[20_000:20_012])), (8, "nowhere " * 12)], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    windows = {tuple(words[k : k + 10]) for k in range(20_000, 20_003)}
    hit = set()
    for k in range(len(words) - 9):
        if tuple(words[k : k + 10]) in windows:
            hit |= set(range(k, k + 10))
    assert (found[1].n_words, found[1].n_hit, found[1].n_items) == (len(words), len(hit), 1)
    assert not found[2].contaminated


def test_long_texts_packed_and_infilled(docs):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(path).encode(LONG, add_special_tokens=False).ids + [0]
    own = sorted((r for r in packing.plan(docs, path).collect() if r.doc_id == 1), key=lambda r: r.piece)
    assert [r.ids_crc32 for r in own] == [zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a : a + 2048])) for a in range(0, len(ids), 2048)]
    assert len({r.sequence_id for r in own}) == len(own)
    restored = {r.doc_id: r for r in infill.digests(docs).collect()}[1]
    assert restored.n == len(LONG) and restored.restored_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
