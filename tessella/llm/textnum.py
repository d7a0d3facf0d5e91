"""Words of whole Arrow batches as 64-bit hashes, in numpy.

The batch operators below need the words of every text, lower-cased A-Z, as
numbers. One pass of array operations over the bytes of a batch does this; no
Python code runs per word.

A word is a maximal run of the bytes 0-9, A-Z, a-z and 0x80-0xFF in UTF-8,
that is `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z. Words end
where their text ends. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
#: For work that leaves nothing but a few numbers or rows a text: some 60 bytes of memory are needed a byte of a slice.
WORK_BYTES = 500_000

_byte = np.arange(256)
WORD_BYTE = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
LETTER = ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit numbers (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(LOWER.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(512)


@dataclass
class Words:
    """hash, start and length (bytes) of each word; those of text i are at first[i]:first[i+1]."""

    hash: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    _values: np.ndarray
    _position: np.ndarray
    _at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def prefix(self, k: int) -> np.ndarray:
        """Hash of the first k bytes of each word; 0 for words of at most k bytes."""
        if not len(self.hash):
            return self.hash
        h = mix(np.add.reduceat(np.where(self._position < k, self._values, np.uint64(0)), self._at) + np.uint64(k))
        return np.where(self.length > k, h, np.uint64(0))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, at least one row each, so that working memory is bounded."""
    at = buffers(texts)[1]  # not the bytes: they are a copy where a text is null
    row, n = 0, len(texts)
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def words(texts: pa.Array) -> Words:
    data, offsets = buffers(texts)
    is_word = WORD_BYTE[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    first_bytes = offsets[:-1][offsets[:-1] < len(data)]
    begins[first_bytes] = is_word[first_bytes]
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.zeros(0, np.uint64)
        zero = np.zeros(0, np.int64)
        return Words(none, zero, zero, np.zeros(len(offsets), np.int64), data, offsets, none, zero, zero)
    inside = np.flatnonzero(is_word)
    at = np.searchsorted(inside, start)
    length = np.diff(np.append(at, len(inside)))
    position = np.arange(len(inside)) - np.repeat(at, length)
    longest = int(length.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    values = _TABLE[data[inside]] * powers[position]
    hashes = mix(np.add.reduceat(values, at))
    return Words(hashes, start, length, np.searchsorted(start, offsets), data, offsets, values, position, at)


def word_hash(text: str) -> np.ndarray:
    """Hashes of the words of one short text, as `words` gives them."""
    return words(pa.array([text])).hash


def kmers(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; of all words together where there are fewer; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - k + 1 + i])
    return out


def distinct_per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each owner 0..n-1."""
    if not len(values):
        return np.zeros(n, np.int64)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)
