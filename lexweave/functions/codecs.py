"""Integer codecs: arrays of whole numbers to 32-bit words and back.

Stored tables use Parquet's own encodings; these serve to measure and compare. All
take values below 2**28, the range in which every codec is exact.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

LIMIT = 1 << 28
BLOCK = 128
#: Bit widths that blockwise codecs may use.
WIDTHS = (*range(14), 16, 20, 32)
S9 = ((28, 1), (14, 2), (9, 3), (7, 4), (5, 5), (4, 7), (3, 9), (2, 14), (1, 28))
#: Runs of (how many, bits) in each selector of Simple-16.
_S16 = "28x1 7x2+14x1 7x1+7x2+7x1 14x1+7x2 14x2 1x4+8x3 1x3+4x4+3x3 7x4 4x5+2x4 2x4+4x5 3x6+2x5 2x5+3x6 4x7 1x10+2x9 2x14 1x28"
S16 = tuple(np.array([int(b) for run in s.split("+") for n, b in [run.split("x")] for _ in range(int(n))]) for s in _S16.split())


def _bits_to_words(bits: np.ndarray) -> np.ndarray:
    """Bits, lowest first, as 32-bit words."""
    raw = np.packbits(bits.astype(np.uint8), bitorder="little")
    raw = np.pad(raw, (0, -len(raw) % 4))
    return raw.view("<u4").astype(np.uint32)


def _words_to_bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words.astype("<u4")).view(np.uint8), bitorder="little")


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Low ``width`` bits of each value, one after the other."""
    if not width or not len(values):
        return np.zeros(0, np.uint32)
    return _bits_to_words(((values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).ravel())


def unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.int64)
    bits = _words_to_bits(words)[: n * width].reshape(n, width).astype(np.int64)
    return bits @ (np.int64(1) << np.arange(width, dtype=np.int64))


def packed_words(width: int, n: int) -> int:
    return -(-width * n // 32)


def _width_of_mean(values: np.ndarray) -> int:
    return max(0, int(values.sum() // len(values)).bit_length() - 1) if len(values) else 0


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of each array's values."""
    run, end = np.r_[0, np.cumsum(values)], np.cumsum(n)
    return run[end] - run[end - n]


def _mean_widths(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``_width_of_mean`` of each array."""
    mean = _sums(v, n) // np.maximum(n, 1)
    return np.where(mean < 1, 0, np.frexp(mean.astype(np.float64))[1] - 1).astype(np.int64)


def null_encode(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint32)


def null_decode(w: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    return w[:n].astype(np.int64), n


def vbyte_encode(v: np.ndarray) -> np.ndarray:
    """Seven bits a byte, high ones first; the lowest bit of a byte says that more follow."""
    groups = np.stack([(v >> s) & 127 for s in (21, 14, 7, 0)], 1)
    started = np.cumsum(groups > 0, 1) > 0
    started[:, 3] = True
    code = (groups << 1) | (np.arange(4) < 3)
    raw = code[started].astype(np.uint8)
    return np.pad(raw, (0, -len(raw) % 4)).view("<u4").astype(np.uint32)


def vbyte_decode(w: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    raw = np.ascontiguousarray(w.astype("<u4")).view(np.uint8)
    ends = np.flatnonzero(raw & 1 == 0)[:n]
    starts = np.r_[0, ends[:-1] + 1][: len(ends)]
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=0)) + 1):
        more = starts + k <= ends
        out[more] = (out[more] << 7) | (raw[starts[more] + k] >> 1)
    return out, -(-int(ends[-1] + 1) // 4) if len(ends) else 0


def _unary(q: np.ndarray) -> np.ndarray:
    bits = np.ones(int(q.sum()) + len(q), bool)
    bits[np.cumsum(q + 1) - 1] = False
    return bits


def rice_encode(v: np.ndarray) -> np.ndarray:
    """Header word with the width; each value's low bits, then its rest in unary."""
    b = _width_of_mean(v)
    q = v >> b
    length = q + 1 + b
    start = np.cumsum(length) - length
    bits = np.zeros(int(length.sum()), bool)
    for k in range(b):
        bits[start + k] = (v >> k) & 1
    ones = np.repeat(start + b, q) + np.arange(q.sum()) - np.repeat(np.cumsum(q) - q, q)
    bits[ones] = True
    return np.r_[np.uint32(b), _bits_to_words(bits)].astype(np.uint32)


def rice_decode(w: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    b = int(w[0])
    bits = _words_to_bits(w[1:])
    zero = np.append(np.flatnonzero(bits == 0), len(bits))
    out, at = np.zeros(n, np.int64), 0
    low = np.int64(1) << np.arange(b, dtype=np.int64)
    for i in range(n):
        end = int(zero[np.searchsorted(zero, at + b)])
        out[i] = ((end - at - b) << b) + int(bits[at : at + b] @ low)
        at = end + 1
    return out, 1 + -(-at // 32)


def rice_encode_many(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of many arrays of ``n`` values each, one after the other, and how many each has: those of ``rice_encode``."""
    width = _mean_widths(v, n)
    b = np.repeat(width, n)
    q = v >> b
    length = q + 1 + b
    words = np.where(n > 0, 1 - (-_sums(length, n) // 32), 0)
    head = np.cumsum(words) - words
    run = np.cumsum(length) - length
    begin = np.r_[run, 0][np.cumsum(n) - n]
    start = run + np.repeat(32 * (head + 1) - begin, n)
    bits = np.zeros(32 * int(words.sum()), bool)
    for k in range(int(width.max(initial=0))):
        wide = b > k
        bits[start[wide] + k] = (v[wide] >> k) & 1
    bits[np.repeat(start + b - (np.cumsum(q) - q), q) + np.arange(q.sum())] = True
    out = _bits_to_words(bits)
    out[head[n > 0]] = width[n > 0]
    return out, words


def rice_decode_many(w: np.ndarray, words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values of many arrays, one after the other: the i-th of each in step i."""
    w = w.astype(np.uint32)
    head = np.cumsum(words) - words
    bits = _words_to_bits(w)
    at_end = np.int64(len(bits))
    place = np.arange(len(bits), dtype=np.int64)
    zero = np.append(np.minimum.accumulate(np.where(bits == 0, place, at_end)[::-1])[::-1], at_end)
    pair = w.astype(np.uint64) | (np.append(w[1:], 0).astype(np.uint64) << np.uint64(32))
    order = np.argsort(-n, kind="stable")
    start, out = np.cumsum(n) - n, np.zeros(int(n.sum()), np.int64)
    b = np.zeros(len(n), np.int64)
    b[n > 0] = w[head[n > 0]]
    at = 32 * (head + 1)
    for i, many in enumerate(np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), "left")):
        rows = order[:many]
        here, width = at[rows], b[rows]
        low = np.where(width > 0, (pair[np.minimum(here >> 5, len(w) - 1)] >> (here & 31).astype(np.uint64)).astype(np.int64) & ((np.int64(1) << width) - 1), 0)
        end = zero[here + width]
        out[start[rows] + i] = ((end - here - width) << width) + low
        at[rows] = end + 1
    return out


def turbo_rice_encode(v: np.ndarray) -> np.ndarray:
    """Header word; all low bits packed, then all rests in unary."""
    k = next(i for i, c in enumerate(WIDTHS) if c >= _width_of_mean(v))
    b = WIDTHS[k]
    parts = [np.array([(b << 6) | k], np.uint32), pack(v, b)]
    if b < 32:
        parts.append(_bits_to_words(_unary(v >> b)))
    return np.concatenate(parts).astype(np.uint32)


def turbo_rice_decode(w: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    b = int(w[0]) >> 6
    at = 1 + packed_words(b, n)
    low = unpack(w[1:at], b, n)
    if b >= 32:
        return low, at
    ends = np.flatnonzero(_words_to_bits(w[at:]) == 0)[:n]
    q = np.diff(ends, prepend=-1) - 1
    return (q << b) + low, at + -(-int(ends[-1] + 1) // 32)


def pfor_block(n: int) -> int:
    return 32 if n < 64 else 64 if n < 128 else 128 if n < 256 else 256


def _pfor_one(v: np.ndarray) -> list[np.ndarray]:
    """Least width from 2 at which a tenth of the block or less are exceptions, chained by their distances."""
    n = len(v)
    most = int(v.max())
    kind, wide = (0, 8) if most < 256 else (1, 16) if most < 65536 else (2, 32)
    for k, b in enumerate(WIDTHS[2:]):
        if b == 32:
            return [np.array([(k << 12) | (2 << 10) | n], np.uint32), v.astype(np.uint32)]
        exceptions, last = [], -1
        for i in np.flatnonzero(v >= 1 << b).tolist():
            while last >= 0 and i - last > 1 << b:
                last += 1 << b
                exceptions.append(last)
            exceptions.append(i)
            last = i
        while last >= 0 and n - 1 - last >= 1 << b:
            last += 1 << b
            exceptions.append(last)
        if len(exceptions) <= 0.1 * n:
            e = np.array(exceptions, np.int64)
            low = np.where(v < 1 << b, v, 0)
            if len(e):
                low[e] = np.append(np.diff(e) - 1, (1 << b) - 1)
            start = int(e[0]) if len(e) else n
            return [np.array([(k << 12) | (kind << 10) | start], np.uint32), pack(low, b), pack(v[e], wide), np.array([len(e)], np.uint32)]
    raise AssertionError


def pfor_encode(v: np.ndarray) -> np.ndarray:
    size = pfor_block(len(v))
    padded = np.pad(v, (0, -len(v) % size))
    return np.concatenate([x for i in range(0, len(padded), size) for x in _pfor_one(padded[i : i + size])]).astype(np.uint32)


def pfor_decode(w: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    size, at, out = pfor_block(n), 0, []
    for _ in range(-(-n // size)):
        head = int(w[at])
        b, wide, start = WIDTHS[2 + (head >> 12)], 8 << ((head >> 10) & 3), head & 1023
        at += 1
        if b == 32:
            out.append(w[at : at + size].astype(np.int64))
            at += size
            continue
        low = unpack(w[at : at + packed_words(b, size)], b, size)
        at += packed_words(b, size)
        where, i = [], start
        while i < size:
            where.append(i)
            i += int(low[i]) + 1
        used = packed_words(wide, len(where))
        low[where] = unpack(w[at : at + used], wide, len(where))
        at += used
        if int(w[at]) != len(where):
            raise ValueError("damaged block")
        at += 1
        out.append(low)
    return (np.concatenate(out)[:n] if out else np.zeros(0, np.int64)), at


def _reach(v: np.ndarray, bits: int) -> np.ndarray:
    """How many values from each on fit the width."""
    big = np.append(np.flatnonzero(v >= 1 << bits), len(v))
    at = np.arange(len(v))
    return big[np.searchsorted(big, at)] - at


def s9_encode(v: np.ndarray) -> np.ndarray:
    """Nine ways to fill 28 bits, tried from the densest on."""
    reach = [_reach(v, bits).tolist() for _, bits in S9]
    values, out, i, n = v.tolist(), [], 0, len(v)
    while i < n:
        for k, (count, bits) in enumerate(S9):
            m = min(count, n - i)
            if reach[k][i] >= m:
                word = k << 28
                for j in range(m):
                    word |= values[i + j] << (bits * j)
                out.append(word)
                i += m
                break
    return np.array(out, np.uint32)


def s9_decode(w: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    out: list[int] = []
    used = 0
    for word in w.tolist():
        if len(out) >= n:
            break
        count, bits = S9[word >> 28]
        mask = (1 << bits) - 1
        out += [(word >> (bits * j)) & mask for j in range(min(count, n - len(out)))]
        used += 1
    return np.array(out, np.int64), used


_S16_LISTS = [(s.tolist(), (np.cumsum(s) - s).tolist()) for s in S16]


def s16_encode(v: np.ndarray) -> np.ndarray:
    """Sixteen ways to fill 28 bits, tried from the densest on."""
    values, out, i, n = v.tolist(), [], 0, len(v)
    while i < n:
        for k, (bits, shift) in enumerate(_S16_LISTS):
            m = min(len(bits), n - i)
            word = k << 28
            for j in range(m):
                x = values[i + j]
                if x >> bits[j]:
                    break
                word |= x << shift[j]
            else:
                out.append(word)
                i += m
                break
    return np.array(out, np.uint32)


def s16_decode(w: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    out: list[int] = []
    used = 0
    for word in w.tolist():
        if len(out) >= n:
            break
        bits, shift = _S16_LISTS[word >> 28]
        out += [(word >> shift[j]) & ((1 << bits[j]) - 1) for j in range(min(len(bits), n - len(out)))]
        used += 1
    return np.array(out, np.int64), used


CODECS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray, int], tuple[np.ndarray, int]]]] = {
    "null": (null_encode, null_decode),
    "vbyte": (vbyte_encode, vbyte_decode),
    "rice": (rice_encode, rice_decode),
    "turbo-rice": (turbo_rice_encode, turbo_rice_decode),
    "pfor": (pfor_encode, pfor_decode),
    "s9": (s9_encode, s9_decode),
    "s16": (s16_encode, s16_decode),
}
#: Codecs that take the arrays of a batch in one go.
MANY = {"rice": (rice_encode_many, rice_decode_many)}
BLOCKWISE = ("turbo-rice", "pfor")


def encode(name: str, values) -> np.ndarray:
    v = np.asarray(values, np.int64)
    if len(v) and (v.min() < 0 or v.max() >= LIMIT):
        raise ValueError("values must be below 2**28")
    return CODECS[name][0](v) if len(v) else np.zeros(0, np.uint32)


def decode(name: str, words, n: int) -> np.ndarray:
    return CODECS[name][1](np.asarray(words, np.uint32), n)[0] if n else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Policy:
    """``coder``, or ``primary:block:leftover:least padding``: whole blocks by the primary coder, the rest by either."""

    primary: str
    block: int = 0
    leftover: str = ""
    least: int = 0

    @classmethod
    def parse(cls, text: str, what: str = "header") -> Policy:
        parts = text.split(":")
        for name in parts[:1] + parts[2:3]:
            if name not in CODECS:
                raise ValueError(f"no such coder: {name!r}")
        if len(parts) == 1:
            if parts[0] in BLOCKWISE:
                raise ValueError("a single coder must not be blockwise")
            return cls(parts[0])
        if len(parts) != 4:
            raise ValueError(f"not a coding policy: {text!r}")
        if parts[0] not in BLOCKWISE or parts[2] in BLOCKWISE:
            raise ValueError("the first coder must be blockwise, the leftover coder must not")
        block = int(parts[1])
        if block <= 0:
            raise ValueError("the block size must be positive")
        if what in ("doc_id", "frequency") and block != BLOCK:
            raise ValueError(f"the block size must be {BLOCK}")
        if what == "position" and block % (BLOCK * 64):
            raise ValueError(f"the block size must be a multiple of {BLOCK * 64}")
        return cls(parts[0], block, parts[2], int(parts[3]))

    def _spans(self, n: int) -> list[tuple[str, int, int, int]]:
        """(coder, from, to, encoded length) of each part of n values."""
        if not self.block:
            return [(self.primary, 0, n, n)] if n else []
        whole = n - n % self.block
        out = [(self.primary, i, i + self.block, self.block) for i in range(0, whole, self.block)]
        if n > whole:
            out.append((self.leftover, whole, n, n - whole) if n - whole < self.least else (self.primary, whole, n, self.block))
        return out

    def encode(self, values) -> np.ndarray:
        v = np.asarray(values, np.int64)
        parts = [encode(c, np.pad(v[a:b], (0, size - (b - a)))) for c, a, b, size in self._spans(len(v))]
        return np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)

    def decode(self, words, n: int) -> np.ndarray:
        w, out = np.asarray(words, np.uint32), []
        for c, a, b, size in self._spans(n):
            values, used = CODECS[c][1](w, size)
            out.append(values[: b - a])
            w = w[used:]
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _flat(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all arrays of a column, and how many each has; null counts as empty."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _column(values: np.ndarray, n: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Arrays of ``n`` values each as a column, null where one is missing."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(values.astype(np.int64)), mask=pa.array(missing))


def _lists(parts: list[np.ndarray], missing: np.ndarray) -> pa.Array:
    return _column(np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array([len(p) for p in parts], np.int64), missing)


def _missing(x: pa.Array) -> np.ndarray:
    return np.asarray(x.is_null().to_numpy(zero_copy_only=False), bool)


def encoded(name: str, values: Column) -> Column:
    """Words of an array column, as bigints."""

    @arrow_udf("array<bigint>")
    def run(x: pa.Array) -> pa.Array:
        v, n = _flat(x)
        if name in MANY:
            if len(v) and (v.min() < 0 or v.max() >= LIMIT):
                raise ValueError("values must be below 2**28")
            return _column(*MANY[name][0](v, n), _missing(x))
        return _lists([encode(name, p) for p in np.split(v, np.cumsum(n)[:-1])] if len(n) else [], _missing(x))

    return run(values)


def decoded(name: str, words: Column, n: Column) -> Column:
    @arrow_udf("array<bigint>")
    def run(x: pa.Array, size: pa.Array) -> pa.Array:
        w, n = _flat(x)
        if name in MANY:
            count = np.where(n > 0, pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
            return _column(MANY[name][1](w, n, count), count, _missing(x))
        return _lists([decode(name, p, s) for p, s in zip(np.split(w, np.cumsum(n)[:-1]), size.to_pylist())] if len(n) else [], _missing(x))

    return run(words, n)


def checksum(values: Column) -> Column:
    """Fold of an array of whole numbers: 31 times what there is, plus the next, modulo 1,000,003."""

    @arrow_udf("bigint")
    def run(x: pa.Array) -> pa.Array:
        v, n = _flat(x)
        start, out = np.cumsum(n) - n, np.zeros(len(n), np.int64)
        order = np.argsort(-n, kind="stable")
        going = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), "left")
        for i, many in enumerate(going):
            rows = order[:many]
            out[rows] = (out[rows] * 31 + v[start[rows] + i]) % 1000003
        return pa.array(out, mask=_missing(x))

    return run(values)


def _words(name: str, v: np.ndarray, n: np.ndarray) -> np.ndarray:
    low = _mean_widths(v, n)
    if name == "null":
        size = n
    elif name == "vbyte":
        size = -(-_sums(1 + (v >= 128) + (v >= 16384) + (v >= 2097152), n) // 4)
    elif name == "rice":
        size = 1 - (-(n * (low + 1) + _sums(v >> np.repeat(low, n), n)) // 32)
    else:
        b = np.where(low <= 13, low, np.where(low <= 16, 16, np.where(low <= 20, 20, 32)))
        size = 1 - (-(b * n) // 32) + np.where(b < 32, -(-(_sums(v >> np.repeat(b, n), n) + n) // 32), 0)
    return np.where(n == 0, 0, size)


#: Codecs whose number of words follows from the values without encoding.
CLOSED = ("null", "vbyte", "rice", "turbo-rice")


def size_of(name: str, values: Column) -> Column:
    """Words that null, vbyte, rice and turbo-rice take, without encoding."""
    if name not in CLOSED:
        raise ValueError(f"no closed form for {name!r}")

    @arrow_udf("bigint")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(_words(name, *_flat(x)), mask=_missing(x))

    return run(values)


def demo(name: str, values: tuple[int, ...] = (1, 0) * 16) -> dict[str, object]:
    """One round trip, its compression ratio and speed."""
    began = time.perf_counter()
    words = encode(name, values)
    back = decode(name, words, len(values))
    seconds = time.perf_counter() - began
    return {"codec": name, "values": len(values), "words": len(words), "ratio": len(values) / max(1, len(words)), "same": back.tolist() == list(values), "m_ints_per_s": len(values) / seconds / 1e6}
