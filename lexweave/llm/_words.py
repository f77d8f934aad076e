"""Vectorised word and n-gram hashing over Arrow string buffers.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the
lower-cased text; every other ASCII character separates. Words are hashed with a
polynomial over their bytes modulo 2**64 that is taken from one running sum, so
the cost is a few array passes per byte and no Python loop runs over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed in one go; bounds the temporary arrays.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

WORD = np.zeros(256, bool)
WORD[ord("0") : ord("9") + 1] = True
WORD[ord("a") : ord("z") + 1] = True
WORD[ord("A") : ord("Z") + 1] = True
WORD[128:] = True

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        for base, name in ((_BASE, "_pow"), (_INV, "_inv")):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            np.cumprod(a, out=a)
            globals()[name] = a
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the whole 64-bit value."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of a batch in text order.

    doc: index of the text in the batch; start, end: byte span in ``data``;
    hash: 64-bit word key; first: for each text, index of its first word, with
    one more entry at the end.
    """

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def trim() -> None:
    """Give freed memory back to the machine, as idle workers otherwise keep what their last task took."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give:
        give(0)


def lean(run: Callable) -> Callable:
    """A function of batches that trims when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text offsets of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Spans of texts of about ``size`` bytes, so that working arrays stay small; a longer text is a span of its own."""
    offsets = buffers(texts)[1]
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1))
        yield i, j
        i = j


def _pieces(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Spans of about PIECE bytes that end at a text's end or, in a long text, between words."""
    n, at, out = len(data), 0, []
    while at < n:
        to = min(n, at + PIECE)
        if to < n:
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:
                end = int(offsets[k + 1])
                while to < end and WORD[data[to]]:
                    hit = np.flatnonzero(~WORD[data[to : min(end, to + 4096)]])
                    to = to + int(hit[0]) if len(hit) else min(end, to + 4096)
        out.append((at, to))
        at = to
    return out


def words(texts: pa.Array, lower: bool = True) -> Words:
    """All words of a batch of texts."""
    if lower and len(texts):
        texts = pc.utf8_lower(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
    data, offsets = buffers(texts)
    cut = np.unique(offsets)
    starts, ends, hashes = [], [], []
    for a, b in _pieces(data, offsets):
        part = data[a:b]
        is_word = WORD[part]
        inner = cut[np.searchsorted(cut, a, "right") : np.searchsorted(cut, b)] - a
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = is_word[:-1]
        before[inner] = False
        s = np.flatnonzero(is_word & ~before)
        if not len(s):
            continue
        after = np.empty(len(part), bool)
        after[-1] = False
        after[:-1] = is_word[1:]
        after[inner - 1] = False
        e = np.flatnonzero(is_word & ~after) + 1
        power, inverse = _powers(len(part))
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=run[1:])
        h = (run[e] - run[s]) * inverse[s]
        hashes.append(mix(h + (e - s).astype(np.uint64)))
        starts.append(s + a)
        ends.append(e + a)
    empty = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else empty
    end = np.concatenate(ends) if ends else empty
    key = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(doc, start, end, key, first, data, offsets)


def word_keys(terms: list[str]) -> np.ndarray:
    """Keys of single words, equal to those that ``words`` gives in a text."""
    out = np.zeros(len(terms), np.uint64)
    for i, t in enumerate(terms):
        w = words(pa.array([t]))
        out[i] = w.hash[0] if len(w.hash) else 0
    return out


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, key) of every run of n words; a text of 1 to n-1 words has one gram, all of it."""
    m = len(w.hash)
    size = np.diff(w.first)
    if m == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = w.hash.copy()
    base = np.uint64(0xD6E8FEB86659FD93)
    for j in range(1, n):
        key *= base
        key[: m - j] += w.hash[j:]
    key = mix(key)
    ok = np.zeros(m, bool)
    ok[: max(0, m - n + 1)] = w.doc[: max(0, m - n + 1)] == w.doc[n - 1 :] if m >= n else False
    doc, key = w.doc[ok], key[ok]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            h = np.uint64(0)
            for x in w.hash[w.first[d] : w.first[d + 1]]:
                h = np.uint64((int(h) * int(base) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            extra[i] = h
        doc = np.concatenate([doc, short])
        key = np.concatenate([key, mix(extra + np.uint64(0x51ED27))])
        order = np.argsort(doc, kind="stable")
        doc, key = doc[order], key[order]
    return doc, key


def sets(doc: np.ndarray, key: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, ascending, and the offsets of the texts in them."""
    if not len(key):
        return key, np.zeros(texts + 1, np.int64)
    edge = np.searchsorted(doc, np.arange(texts + 1))
    key = key.copy()
    keep = np.ones(len(key), bool)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a > 1:
            key[a:b].sort()
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return key[keep], kept[edge]
