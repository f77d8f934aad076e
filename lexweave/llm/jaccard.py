"""N-gram Jaccard join with vertical partitioning.

Two documents are near when their sets of word n-grams have a Jaccard similarity
of at least ``threshold``. The join is exact (n-grams and sets are told apart by
64-bit keys); it goes through these steps, each of which is a pass or a shuffle of
packed arrays:

1. Signatures: equal n-gram sets collapse to one, whose smallest id stands for it.
   A task sends a set on once, however many copies it reads.
2. Global order: the n-grams that occur in two sets or more are ordered by
   frequency class, then by key, rare ones first. An n-gram that a large share of
   all sets hold is known from the first pass; its entries are spread by set, and
   never gathered. A set of whose n-grams less than ``threshold`` occur elsewhere
   is near nothing and is left out from here on.
3. Candidates: near sets share an n-gram early in that order (prefix and positional
   filter, with the length filter). An n-gram that leads up to ``HOT`` sets gives
   candidate pairs. The sets of any other are hot and need no pairs: each has a
   home, the most frequent hot n-gram that leads it, and the homes that meet under
   a hot n-gram are compared as wholes, block by block.
4. Vertical partitioning: the global order is cut into fragments; each counts the
   partial overlaps of the candidate pairs in its own range, and the sum per pair
   decides. A pair goes to the fragments that its smaller set reaches. For two
   blocks of hot sets the partial overlaps of a fragment are a matrix, the product
   of the blocks' incidence matrices, and all their pairs are summed at once.

``classes`` has one row for each document: the smallest id of its connected group
of near documents, and how many other n-gram sets its own is linked to. ``near`` has
the pairs themselves between distinct sets, under the ids that stand for them, and a
row (id that stands for the set, id, 1.0) for each further document with an equal
set; ``expand`` makes all pairs of documents of them.

Defined results: rows without id are left out; null, empty and wordless texts have
no n-gram, are near nothing and are a class of their own without links; a text of
fewer words than ``n`` is one n-gram; a very long text is one set like any other;
repeated rows are one document; rows of one id with different texts are compared
each, and a pair of them is left out; of ties the smallest id stands for a set and a
class; an empty table gives an empty result; other columns are not read by ``near``
and ``classes`` and pass through ``keep_one`` untouched, whatever their names. In
``keep_one`` the smallest id of each class stays, and rows without id stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm._words import grams, lean, mix, sets, slices, trim, words
from lexweave.session import cut, ship, small

N = 5
THRESHOLD = 0.4
#: Entries (n-grams of sets) that a fragment of all keys should hold, and one of the global order or a part; sets how many there are.
FRAGMENT, PART = 2_000_000, 750_000
#: Sets that an n-gram may lead in candidate pairs; those of any other are compared in blocks.
HOT = 64
#: Sets of a block, and entries that they should not exceed.
BLOCK, BLOCK_ENTRIES = 512, 1_000_000
#: An n-gram is spread by set where it is in this share of all sets (four times as much of a slice's, and SEEN of them).
SHARE, SEEN = 1 / 256, 16
#: Pairs that are looked at in one go.
CHUNK = 500_000
#: Columns of a fragment's incidence matrix.
COLUMNS = 2048
TEXT_BYTES = 2 << 20


def _slices(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    for i, j in slices(b.column(1), TEXT_BYTES):
        yield b.column(0)[i:j], b.column(1)[i:j]


def _signed(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, their offsets, and the signature of each set (0: no n-gram)."""
    w = words(texts)
    key, edge = sets(*grams(w, n), len(texts))
    size = np.diff(edge)
    sig = np.zeros(len(texts), np.uint64)
    some = size > 0
    if some.any():
        spread = mix(key ^ np.uint64(0xA0761D6478BD642F))
        sig[some] = mix(np.add.reduceat(spread, edge[:-1][some]) + size[some].astype(np.uint64))
    return key, edge, sig


def _signatures(n: int, share: float, seen: int):
    """Rows (doc_id, signature, n-grams) of texts, and (null, n-gram, sets) where many sets of a slice hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "sig", "size"]
        for b in batches:
            for ids, texts in _slices(b):
                key, edge, sig = _signed(texts, n)
                size = np.diff(edge)
                ok = np.flatnonzero(size > 0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(ok)), pa.array(sig[ok].view(np.int64)), pa.array(size[ok])], names)
                one = ok[np.unique(sig[ok], return_index=True)[1]]
                if len(one) >= seen:
                    chosen = np.zeros(len(size), bool)
                    chosen[one] = True
                    held = np.sort(key[np.repeat(chosen, size)])
                    first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
                    count = np.diff(np.append(first, len(held)))
                    many = count >= max(seen, 4 * share * len(one))
                    if many.any():
                        yield pa.RecordBatch.from_arrays([pa.nulls(int(many.sum()), pa.int64()), pa.array(held[first[many]].view(np.int64)), pa.array(count[many])], names)

    return run


class _Heavy(NamedTuple):
    """N-grams that a large share of all sets hold: sorted keys, and their frequency classes."""

    keys: np.ndarray
    kinds: np.ndarray

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are heavy, and their places."""
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return (self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)), at


def _part_of(sig: np.ndarray, parts: int) -> np.ndarray:
    return ((sig >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _part_column(sig: str, parts: int) -> Column:
    return (F.shiftrightunsigned(sig, 33) % parts).cast("int")


def _fragment_of(key: np.ndarray, fragments: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(fragments)).astype(np.int64)


def _cuts(values: np.ndarray) -> list[int]:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.r_[True, values[1:] != values[:-1]]), len(values)).tolist() if len(values) else [0]


PACKED = "frag int, sigs binary, counts binary, keys binary"


def _scatter(n: int, fragments: int, heavy: _Heavy):
    """Each set's n-grams by fragment, a set once a task: a row holds the sets of a slice that have some there.

    Heavy ones go to as many fragments again, by set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            for _, texts in _slices(b):
                key, edge, sig = _signed(texts, n)
                size = np.diff(edge)
                new = np.zeros(len(size), bool)
                new[np.unique(sig, return_index=True)[1]] = True
                new &= (size > 0) & np.array([x not in done for x in sig.tolist()], bool)
                done.update(sig[new].tolist())
                if not new.any():
                    continue
                key, sig, size = key[np.repeat(new, size)], sig[new], size[new]
                owner = np.repeat(np.arange(len(size)), size)
                frag = _fragment_of(key, fragments)
                if len(heavy.keys):
                    known, _ = heavy.find(key)
                    frag = np.where(known, fragments + _part_of(sig, fragments)[owner], frag)
                order = np.argsort(frag.astype(np.uint16) if fragments <= 32768 else frag, kind="stable")
                frag, owner, key = frag[order], owner[order], key[order]
                cuts = _cuts(frag)
                rows: list[list] = [[], [], [], []]
                for a, z in zip(cuts[:-1], cuts[1:]):
                    first = _cuts(owner[a:z])
                    who = owner[a:z][first[:-1]]
                    for col, value in zip(rows, (int(frag[a]), sig[who].tobytes(), np.diff(first).astype(np.uint32).tobytes(), key[a:z].tobytes())):
                        col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], ["frag", "sigs", "counts", "keys"])

    return run


def _read(b: pa.RecordBatch, r: int, *columns: tuple[str, type]) -> list[np.ndarray]:
    return [np.frombuffer(b.column(name)[r].as_buffer(), kind) for name, kind in columns]


_SETS = (("sigs", np.uint64), ("sizes", np.uint32), ("counts", np.uint32), ("keys", np.uint64))


def _gather(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a whole fragment: its number, distinct signatures, and distinct (key, signature index) sorted by key."""
    held, frag = [], 0
    for b in batches:
        for r in range(b.num_rows):
            frag = b.column("frag")[r].as_py()
            held.append(_read(b, r, ("sigs", np.uint64), ("counts", np.uint32), ("keys", np.uint64)))
    if not held:
        return None
    sig, count, key = (np.concatenate(x) for x in zip(*held))
    del held
    known, index = np.unique(sig, return_inverse=True)
    owner = np.repeat(index.astype(np.int32), count)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
    return frag, known, key[new], owner[new]


def _frequency(key: np.ndarray) -> np.ndarray:
    """How often each entry's key occurs in a sorted array."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.append(starts, len(key)))
    return np.repeat(n, n)


SEGMENTS = "part int, sigs binary, sizes binary, counts binary, keys binary, classes binary, hist array<bigint>"
_SEGMENTS = ["part", "sigs", "sizes", "counts", "keys", "classes", "hist"]


def _segment(part: int, sig: np.ndarray, size: np.ndarray, count: np.ndarray, key: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    raw = (sig.tobytes(), size.astype(np.uint32).tobytes(), count.astype(np.uint32).tobytes(), key.tobytes(), kind.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([x], pa.binary()) for x in raw], pa.array([np.bincount(kind.astype(np.uint8), minlength=64).tolist()], pa.list_(pa.int64()))], _SEGMENTS)


def _segments(parts: int, fragments: int, heavy: _Heavy):
    """Entries that occur in two sets or more, with their frequency class, by part of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches)
        if got is None:
            return
        frag, known, key, owner = got
        if frag < fragments:
            n = _frequency(key)
            key, owner, n = key[n > 1], owner[n > 1], n[n > 1]
            kind = np.log2(n).astype(np.uint8)
        else:
            kind = heavy.kinds[heavy.find(key)[1]]
        part = _part_of(known, parts)[owner]
        order = np.lexsort((owner, part))
        key, owner, kind, part = key[order], owner[order], kind[order], part[order]
        cuts = _cuts(part)
        for a, z in zip(cuts[:-1], cuts[1:]):
            first = _cuts(owner[a:z])
            who = owner[a:z][first[:-1]]
            yield _segment(int(part[a]), known[who], np.zeros(0), np.diff(first), key[a:z], kind[a:z])

    return run


_ENTRIES = (*_SETS, ("classes", np.uint8))


def _sizes(parts: int):
    """Rows (signature, n-grams) packed by part, as segments without entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, 1 << 16):
            sig, size = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sig = sig.view(np.uint64)
            part = _part_of(sig, parts)
            order = np.argsort(part, kind="stable")
            sig, size, part = sig[order], size[order], part[order]
            cuts = _cuts(part)
            none = np.zeros(0, np.uint8)
            for a, z in zip(cuts[:-1], cuts[1:]):
                yield _segment(int(part[a]), sig[a:z], size[a:z], none, none, none)

    return run


def _active(threshold: float):
    """Of a part: the sets of whose n-grams enough occur elsewhere, each one's in global order, in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, sizes, part = [], [], 0
        for b in batches:
            for r in range(b.num_rows):
                part = b.column("part")[r].as_py()
                row = _read(b, r, *_ENTRIES)
                (got if len(row[2]) else sizes).append(row)
        if not got:
            return
        sig, _, count, key, kind = (np.concatenate(x) for x in zip(*got))
        known, size = (np.concatenate(x) for x in list(zip(*sizes))[:2])
        order = np.argsort(known)
        sig = np.repeat(sig, count)
        size = size[order][np.searchsorted(known[order], sig)]
        order = np.lexsort((key, kind, sig))
        sig, size, key, kind = sig[order], size[order], key[order], kind[order]
        n = _frequency(sig)
        ok = n >= np.ceil(threshold * size.astype(np.int64) - 1e-9)
        sig, size, key, kind = sig[ok], size[ok], key[ok], kind[ok]
        if len(sig):
            first = _cuts(sig)
            yield _segment(part, sig[first[:-1]], size[first[:-1]], np.diff(first), key, kind)

    return run


def _cutter(hist: list[int], fragments: int):
    """Fragment numbers of (class, key): consecutive ranges of the global order of about equal mass."""
    total = max(1, sum(hist))
    parts = np.array([max(1, round(fragments * h / total)) if h else 1 for h in hist], np.uint64)
    base = np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)

    def cut_at(kind: np.ndarray, key: np.ndarray) -> np.ndarray:
        return base[kind] + (((key >> np.uint64(32)) * parts[kind]) >> np.uint64(32)).astype(np.int64)

    return cut_at, int(base[-1])


VERTICAL = "frag int, role int, a binary, b binary, c binary, d binary"
_VERTICAL = ["frag", "role", "a", "b", "c", "d"]


def _rows_by(frag: np.ndarray, role: int, columns: list[np.ndarray]) -> pa.RecordBatch | None:
    """One row for each fragment, with the columns' entries that belong to it."""
    if not len(frag):
        return None
    order = np.argsort(frag, kind="stable")
    frag, columns = frag[order], [c[order] for c in columns]
    cuts = np.append(np.flatnonzero(np.r_[True, frag[1:] != frag[:-1]]), len(frag)).tolist()
    data = [pa.array([c[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:])], pa.binary()) for c in columns]
    while len(data) < 4:
        data.append(pa.nulls(len(cuts) - 1, pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(frag[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(cuts) - 1, role, np.int32)), *data], _VERTICAL)


def _leading(b: pa.RecordBatch, r: int, threshold: float) -> list[np.ndarray]:
    """Signature, key, class, size and rest of the set's n-grams (itself counted) of the first n-grams of a part's sets."""
    sig, size, count, key, kind = _read(b, r, *_ENTRIES)
    end = np.repeat(np.cumsum(count, dtype=np.int64), count)
    sig, size = np.repeat(sig, count), np.repeat(size, count).astype(np.int64)
    # those that occur in no other set come first in the order
    left = end - np.arange(len(key))
    ok = left >= np.ceil(threshold * size - 1e-9)
    return [sig[ok], key[ok], kind[ok], size[ok], left[ok]]


def _prefixes(threshold: float, cut_at, heavy: _Heavy):
    """The first n-grams of each set that aren't heavy, by fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                sig, key, kind, size, left = _leading(b, r, threshold)
                if len(heavy.keys):
                    ok = ~heavy.find(key)[0]
                    sig, key, kind, size, left = sig[ok], key[ok], kind[ok], size[ok], left[ok]
                out = _rows_by(cut_at(kind, key), 0, [sig, key, size.astype(np.uint32), left.astype(np.uint32)])
                if out is not None:
                    yield out

    return run


CANDIDATES = "hot boolean, a bigint, b bigint, na bigint, nb bigint"


def _found(hot: bool, *columns: np.ndarray) -> pa.RecordBatch:
    data = [pa.array(c.astype(np.int64) if c.dtype != np.uint64 else c.view(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), hot)), *data], ["hot", "a", "b", "na", "nb"])


def _heavy_members(threshold: float, heavy: _Heavy):
    """Rows (hot, set, n-gram, size, size) of the sets that a heavy n-gram leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                sig, key, _, size, _ = _leading(b, r, threshold)
                ok = heavy.find(key)[0]
                yield _found(True, sig[ok], key[ok], size[ok], size[ok])

    return run


def _expand(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every j in lo[i]..hi[i]-1, in pieces of about CHUNK."""
    n = np.maximum(hi - lo, 0)
    run = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(run, run[at] + CHUNK, "right")) - 1)
        i = np.repeat(np.arange(at, to), n[at:to])
        j = np.arange(run[at], run[to]) - np.repeat(run[at:to], n[at:to]) + lo[i]
        yield i, j
        at = to


def _candidates(threshold: float, hot: int):
    """Candidate pairs under the n-grams of a fragment that lead up to ``hot`` sets, and the sets of the others."""
    need = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_read(b, r, ("a", np.uint64), ("b", np.uint64), ("c", np.uint32), ("d", np.uint32)) for b in batches for r in range(b.num_rows)]
        if not got:
            return
        sig, key, size, left = (np.concatenate(x) for x in zip(*got))
        del got
        size, left = size.astype(np.int64), left.astype(np.int64)
        order = np.argsort(key, kind="stable")
        many = np.empty(len(key), bool)
        many[order] = _frequency(key[order]) > hot
        if many.any():
            yield _found(True, sig[many], key[many], size[many], size[many])
            sig, key, size, left = sig[~many], key[~many], size[~many], left[~many]
        if not len(key):
            return
        known, index = np.unique(sig, return_inverse=True)
        order = np.lexsort((index, size, key))
        index, key, size, left = index[order], key[order], size[order], left[order]
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]]).astype(np.int64)
        wide = int(size.max()) + 2
        # the smaller set of a pair comes first in its group
        most = np.minimum(np.floor(size / threshold + 1e-9).astype(np.int64), wide - 1)
        hi = np.searchsorted(group * wide + size, group * wide + most, "right")
        hi[left < np.ceil(2 * need * size - 1e-9)] = 0
        size_of = np.zeros(len(known), np.int64)
        size_of[index] = size
        seen = np.zeros(0, np.int64)

        def told(seen: np.ndarray) -> pa.RecordBatch:
            x, y = seen // len(known), seen % len(known)
            return _found(False, known[x], known[y], size_of[x], size_of[y])

        for i, j in _expand(np.arange(len(hi)) + 1, hi):
            ok = np.minimum(left[i], left[j]) >= np.ceil(need * (size[i] + size[j]) - 1e-9)
            seen = np.union1d(seen, index[i[ok]] * len(known) + index[j[ok]])
            if len(seen) > 4 * CHUNK:
                yield told(seen)
                seen = np.zeros(0, np.int64)
        yield told(seen)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hot sets of a part (rows of a part with its members) by home and block."""
    for b in batches:
        for r in range(b.num_rows):
            sig, size, count, key = _read(b, r, *_SETS)
            members = b.column("members")[r].values
            name, home, block = (members.field(k).to_numpy(zero_copy_only=False) for k in ("sig", "home", "block"))
            at = np.searchsorted(sig, name.view(np.uint64))
            edge = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
            order = np.lexsort((at, block, home))
            at, home, block = at[order], home[order], block[order]
            new = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (block[1:] != block[:-1])])
            for a, z in zip(new.tolist(), np.append(new[1:], len(at)).tolist()):
                mine = at[a:z]
                keys = np.concatenate([key[edge[m] : edge[m + 1]] for m in mine.tolist()])
                raw = (sig[mine].tobytes(), size[mine].tobytes(), count[mine].tobytes(), keys.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([home[a]], pa.int64()), pa.array([block[a]], pa.int64()), *[pa.array([x], pa.binary()) for x in raw]], ["home", "block", "sigs", "sizes", "counts", "keys"])


def overlaps(ka: np.ndarray, oa: np.ndarray, na: int, kb: np.ndarray, ob: np.ndarray, nb: int) -> np.ndarray:
    """Common n-grams of all pairs of two blocks (keys, owners, number of sets), fragment by fragment.

    A frequent n-gram is a column of the fragment's incidence matrices; those in few
    sets of both blocks are counted from their lists.
    """
    out = np.zeros((na, nb), np.float32)
    both = np.intersect1d(ka, kb)
    if not len(both):
        return out

    def lists(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.searchsorted(both, key)
        at[at == len(both)] = 0
        ok = both[at] == key
        at, owner = at[ok], owner[ok]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order], np.searchsorted(at[order], np.arange(len(both) + 1))

    ca, xa, ea = lists(ka, oa)
    cb, xb, eb = lists(kb, ob)
    wide = np.diff(ea) * np.diff(eb) * 32 >= na * nb
    column = np.cumsum(wide) - 1
    for lo in range(0, int(wide.sum()), COLUMNS):
        x, y = np.zeros((na, COLUMNS), np.float32), np.zeros((nb, COLUMNS), np.float32)
        for m, c, o in ((x, ca, xa), (y, cb, xb)):
            mine = wide[c] & (column[c] >= lo) & (column[c] < lo + COLUMNS)
            m[o[mine], column[c[mine]] - lo] = 1
        out += x @ y.T
    rest = np.flatnonzero(~wide[ca])
    flat = out.reshape(-1)
    for i, j in _expand(eb[ca[rest]], eb[ca[rest] + 1]):
        flat += np.bincount(xa[rest[i]] * np.int64(nb) + xb[j], minlength=na * nb).astype(np.float32)
    return out


def _joint(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest row number of the connected part of each row and column, the number of rows where there is none."""
    none = link.shape[0]
    rows = np.arange(none)
    while True:
        columns = np.where(link, rows[:, None], none).min(0, initial=none)
        new = np.minimum(rows, np.where(link, columns[None, :], none).min(1, initial=none))
        if (new == rows).all():
            return rows, columns
        rows = new


def _compare(threshold: float, pairs: bool):
    """All pairs of two blocks: the pairs that are near, or (set, null, links) and (set, set of its connected part, null)."""

    def run(table: pa.Table) -> pa.Table:
        sides: list[list] = [[], []]
        for b in table.to_batches():
            for r in range(b.num_rows):
                sides[b.column("side")[r].as_py()].append(_read(b, r, *_SETS))
        load = lambda s: [np.concatenate(x) for x in zip(*s)]
        sig, size, count, key = load(sides[0])
        same = not sides[1]
        sig2, size2, count2, key2 = (sig, size, count, key) if same else load(sides[1])
        common = overlaps(key, np.repeat(np.arange(len(sig)), count), len(sig), key2, np.repeat(np.arange(len(sig2)), count2), len(sig2)).astype(np.float64)
        union = size[:, None].astype(np.float64) + size2[None, :] - common
        link = common + 1e-9 >= threshold * union
        if same:
            np.fill_diagonal(link, False)
        as_long = lambda x: pa.array(x.view(np.int64))
        if pairs:
            i, j = np.nonzero(np.triu(link) if same else link)
            return pa.table({"a": as_long(sig[i]), "b": as_long(sig2[j]), "jaccard": np.round(common[i, j] / union[i, j], 6)})
        counts = [(sig, link.sum(1))] + ([] if same else [(sig2, link.sum(0))])
        if same:
            link |= np.eye(len(sig), dtype=bool)  # a set's row and column are one
        part, part2 = _joint(link)
        ok = part < np.arange(len(sig))
        edges = [(sig[ok], sig[part[ok]])]
        if not same:
            ok = part2 < len(sig)
            edges.append((sig2[ok], sig[part2[ok]]))
        out = [pa.table({"a": as_long(s[n > 0]), "b": pa.nulls(int((n > 0).sum()), pa.int64()), "n": pa.array(n[n > 0].astype(np.int64))}) for s, n in counts]
        out += [pa.table({"a": as_long(u), "b": as_long(v), "n": pa.nulls(len(u), pa.int64())}) for u, v in edges]
        trim()
        return pa.concat_tables(out)

    return run


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to runs of some ``rows``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


ROUTES = "part int, role int, a binary, b binary, c binary, d binary, e binary"


def _by_part(parts: int):
    """Pairs, packed, by the part of their smaller set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 1 << 16):
            a, b, na, nb = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            part = _part_of(a.view(np.uint64), parts)
            order = np.lexsort((b, a, part))
            a, b, na, nb, part = a[order], b[order], na[order], nb[order], part[order]
            cuts = _cuts(part)
            for x, z in zip(cuts[:-1], cuts[1:]):
                raw = (a[x:z].tobytes(), b[x:z].tobytes(), na[x:z].astype(np.uint32).tobytes(), nb[x:z].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([part[x]], pa.int32()), pa.array([1], pa.int32()), *[pa.array([v], pa.binary()) for v in raw], pa.nulls(1, pa.binary())], ["part", "role", "a", "b", "c", "d", "e"])

    return run


_PAIR = (("a", np.uint64), ("b", np.uint64), ("c", np.uint32), ("d", np.uint32))


def _spread(cut_at, fragments: int, parts: int, heavy: _Heavy):
    """A part's sets by fragment, and its pairs to the fragments that their smaller set reaches.

    Heavy n-grams are counted where a pair's larger set lies: each part is a further
    fragment, with the heavy entries of its own sets and of those that they are paired with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, pairs = None, []
        for b in batches:
            for r in range(b.num_rows):
                if b.column("role")[r].as_py():
                    pairs.append(_read(b, r, *_PAIR))
                else:
                    sets = _read(b, r, ("a", np.uint64), ("c", np.uint32), ("d", np.uint64), ("e", np.uint8)), b.column("part")[r].as_py()
        if sets is None:
            return
        (known, count, key, kind), part = sets
        owner, frag = np.repeat(np.arange(len(known)), count), cut_at(kind, key)
        some = heavy.find(key)[0]
        mine = owner[some], key[some]
        if some.any():
            yield _rows_by(np.full(len(mine[0]), fragments + part), 0, [known[mine[0]], mine[1]])
            owner, key, frag = owner[~some], key[~some], frag[~some]
        if len(key):
            yield _rows_by(frag, 0, [known[owner], key])
        new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (frag[1:] != frag[:-1])])[: len(owner)]  # in global order, so by fragment
        frag, edge = frag[new], np.searchsorted(owner[new], np.arange(len(known) + 1))
        spots = np.searchsorted(mine[0], np.arange(len(known) + 1))
        for a, b2, na, nb in pairs:
            at = np.searchsorted(known, a)
            for i, j in _expand(edge[at], edge[at + 1]):
                yield _rows_by(frag[j], 1, [a[i], b2[i], na[i], nb[i]])
            ok = np.flatnonzero(spots[at] < spots[at + 1])
            if len(ok):
                there = fragments + _part_of(b2[ok], parts)
                yield _rows_by(there, 1, [a[ok], b2[ok], na[ok], nb[ok]])
                sent = np.unique(np.stack([there, at[ok]]), axis=1)
                for i, j in _expand(spots[sent[1]], spots[sent[1] + 1]):
                    yield _rows_by(sent[0][i], 0, [known[sent[1][i]], mine[1][j]])

    return run


PAIRS = "a bigint, b bigint, na bigint, nb bigint"


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlaps of the candidates in the fragment of the partition."""
    segments, pairs = [], []
    for b in batches:
        for r, role in enumerate(b.column("role").to_pylist()):
            if role:
                pairs.append(_read(b, r, *_PAIR))
            else:
                segments.append(_read(b, r, ("a", np.uint64), ("b", np.uint64)))
    if not segments or not pairs:
        return
    sig, key = (np.concatenate(x) for x in zip(*segments))
    known, owner = np.unique(sig, return_inverse=True)
    keys, rank = np.unique(key, return_inverse=True)
    wide = len(keys)
    slot = np.unique(owner * wide + rank)
    edge = np.searchsorted(slot, np.arange(len(known) + 1) * wide)
    a, b2, na, nb = (np.concatenate(x) for x in zip(*pairs))
    del pairs
    for lo in range(0, len(a), CHUNK):
        some = slice(lo, lo + CHUNK)
        p, q = np.searchsorted(known, a[some]), np.searchsorted(known, b2[some])
        p[p == len(known)], q[q == len(known)] = 0, 0
        ok = np.flatnonzero((known[p] == a[some]) & (known[q] == b2[some]))
        p, q = p[ok], q[ok]
        flip = np.diff(edge)[p] > np.diff(edge)[q]
        p, q = np.where(flip, q, p), np.where(flip, p, q)
        total = np.zeros(len(ok), np.int64)
        for i, j in _expand(edge[p], edge[p + 1]):
            want = slot[j] % wide + q[i] * wide
            spot = np.searchsorted(slot, want)
            spot[spot == len(slot)] = 0
            total += np.bincount(i[slot[spot] == want], minlength=len(ok))
        ok, total = ok[total > 0] + lo, total[total > 0]
        yield pa.RecordBatch.from_arrays([pa.array(a[ok].view(np.int64)), pa.array(b2[ok].view(np.int64)), *[pa.array(v.astype(np.int64)) for v in (na[ok], nb[ok], total)]], ["a", "b", "na", "nb", "common"])


class Options(NamedTuple):
    """Parameters of the join; those after ``threshold`` only say how it is cut."""

    n: int = N
    threshold: float = THRESHOLD
    hot: int = HOT
    block: int = BLOCK
    share: float = SHARE
    seen: int = SEEN


def _rows(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def _join(docs: DataFrame, o: Options, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """signed (doc_id, sig, size), sets (sig, rep, size), near sets (a, b, jaccard), and of hot sets (a, b, n) as ``_compare`` has it or further near sets."""
    spark = docs.sparkSession
    ship(spark)
    rows = _rows(docs)
    first = cut(rows.mapInArrow(lean(_signatures(o.n, o.share, o.seen)), "doc_id bigint, sig bigint, size bigint"), "jaccard-signed")
    signed = first.filter("doc_id is not null")
    reps = cut(signed.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size")), "jaccard-sets")
    n_sets, total = reps.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # a set has at most so many n-grams that a share of all hold: the list is bounded by the share, not by the input
    common = first.filter("doc_id is null").groupBy("sig").agg(F.sum("size").alias("n")).filter(F.col("n") >= max(o.seen, o.share * n_sets)).orderBy("sig").collect()
    keys = np.array([r.sig for r in common], np.int64).view(np.uint64)
    kinds = np.log2(np.array([r.n for r in common], float)).astype(np.uint8)
    heavy = _Heavy(keys[np.argsort(keys)], kinds[np.argsort(keys)])
    least = spark.sparkContext.defaultParallelism
    parts, keyed = max(least, ceil(total / PART)), max(least, ceil(total / FRAGMENT))
    scattered = rows.mapInArrow(lean(_scatter(o.n, keyed, heavy)), PACKED).repartitionById(keyed * (1 + bool(common)), "frag")
    segments = scattered.mapInArrow(lean(_segments(parts, keyed, heavy)), SEGMENTS).unionByName(reps.select("sig", "size").mapInArrow(lean(_sizes(parts)), SEGMENTS))
    active = cut(segments.repartitionById(parts, "part").mapInArrow(lean(_active(o.threshold)), SEGMENTS), "jaccard-active")
    hist = [0] * 64
    for r in active.select(F.posexplode("hist").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():
        hist[r.k] = r.v
    cut_at, fragments = _cutter(hist, max(least, ceil(sum(hist) / PART)))
    active = active.drop("hist")
    found = active.mapInArrow(lean(_prefixes(o.threshold, cut_at, heavy)), VERTICAL).repartitionById(fragments, "frag").mapInArrow(lean(_candidates(o.threshold, o.hot)), CANDIDATES)
    if common:
        found = found.unionByName(active.mapInArrow(lean(_heavy_members(o.threshold, heavy)), CANDIDATES))
    found = cut(found, "jaccard-candidates")
    cold = found.filter("not hot").select("a", "b", "na", "nb").distinct()
    hot = found.filter("hot").select(F.col("a").alias("sig"), F.col("b").alias("key"), F.col("na").alias("size"))
    frequency = hot.groupBy("key").agg(F.count("*").alias("n"))
    home = cut(hot.join(frequency, "key").groupBy("sig").agg(F.max(F.struct("n", "key")).alias("m"), F.first("size").alias("size")).select("sig", F.col("m.key").alias("home"), "size"), "jaccard-homes")
    n_hot = home.count()
    blocked = None
    if n_hot:
        held = home.groupBy("home").agg(F.count("*").alias("c"), F.sum("size").alias("m"))
        held = held.select("home", F.greatest(F.ceil(F.col("c") / o.block), F.ceil(F.col("m") / BLOCK_ENTRIES)).cast("bigint").alias("blocks"))
        member = home.join(held, "home").select("sig", "home", F.pmod(F.xxhash64("sig"), F.col("blocks")).alias("block"), _part_column("sig", parts).alias("part"))
        packed = member.groupBy("part").agg(F.collect_list(F.struct("sig", "home", "block")).alias("members"))
        blocks = cut(active.join(packed, "part").select("sigs", "sizes", "counts", "keys", "members").mapInArrow(lean(_blocks), "home bigint, block bigint, sigs binary, sizes binary, counts binary, keys binary"), "jaccard-blocks")
        touch = hot.join(home.select("sig", "home"), "sig").select("key", "home").distinct()
        met = touch.withColumnRenamed("home", "h1").join(touch.withColumnRenamed("home", "h2"), "key").filter("h1 <= h2").select("h1", "h2").distinct()
        met = cut(met, "jaccard-met")
        last = lambda h, k: held.select(F.col("home").alias(h), (F.col("blocks") - 1).alias(k))
        units = met.join(last("h1", "k1"), "h1").join(last("h2", "k2"), "h2").withColumn("b1", F.explode(F.sequence(F.lit(0).cast("bigint"), "k1")))
        units = units.withColumn("b2", F.explode(F.sequence(F.when(F.col("h1") == F.col("h2"), F.col("b1")).otherwise(0), "k2"))).select("h1", "b1", "h2", "b2")
        side = lambda k, us: us.join(blocks.select(F.col("home").alias(f"h{k + 1}"), F.col("block").alias(f"b{k + 1}"), F.lit(k).alias("side"), "sigs", "sizes", "counts", "keys"), [f"h{k + 1}", f"b{k + 1}"]).select("h1", "b1", "h2", "b2", "side", "sigs", "sizes", "counts", "keys")
        both = side(0, units).unionByName(side(1, units.filter("h1 <> h2 or b1 <> b2")))
        blocked = cut(both.groupBy("h1", "b1", "h2", "b2").applyInArrow(_compare(o.threshold, pairs), "a bigint, b bigint, jaccard double" if pairs else "a bigint, b bigint, n bigint"), "jaccard-blocked")
        of = lambda sig, h: small(home.select(F.col("sig").alias(sig), F.col("home").alias(h)), n_hot, 48)
        cold = cold.join(of("a", "ha"), "a", "left").join(of("b", "hb"), "b", "left").withColumns({"h1": F.least("ha", "hb"), "h2": F.greatest("ha", "hb"), "two": F.col("ha").isNotNull() & F.col("hb").isNotNull()})
        cold = cold.join(small(met.withColumn("two", F.lit(True)), met.count(), 48), ["h1", "h2", "two"], "left_anti").select("a", "b", "na", "nb")
    cold = cut(cold, "jaccard-pairs")
    routed = active.select("part", F.lit(0).alias("role"), F.col("sigs").alias("a"), F.lit(None).cast("binary").alias("b"), F.col("counts").alias("c"), F.col("keys").alias("d"), F.col("classes").alias("e"))
    routed = routed.unionByName(cold.mapInArrow(lean(_by_part(parts)), ROUTES)).repartitionById(parts, "part")
    partial = routed.mapInArrow(lean(_spread(cut_at, fragments, parts, heavy)), VERTICAL).repartitionById(fragments + parts * bool(common), "frag").mapInArrow(lean(_overlaps), PAIRS + ", common bigint")
    summed = partial.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("common").alias("common"))
    union = F.col("na") + F.col("nb") - F.col("common")
    near_sets = cut(summed.filter(F.col("common") + 1e-9 >= o.threshold * union).select("a", "b", F.round(F.col("common") / union, 6).alias("jaccard")), "jaccard-near")
    if blocked is None:
        blocked = spark.createDataFrame([], "a bigint, b bigint, jaccard double" if pairs else "a bigint, b bigint, n bigint")
    return signed, reps, near_sets, blocked


def near(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **cuts) -> DataFrame:
    """Rows (doc_a, doc_b, jaccard), doc_a < doc_b; see the module for what a row stands for."""
    signed, reps, near_sets, blocked = _join(docs, Options(n, threshold, **cuts), True)
    equal = signed.join(reps.select("sig", F.col("rep").alias("doc_a")), "sig").filter("doc_a < doc_id").select("doc_a", F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    rep = lambda sig, doc: reps.select(F.col("sig").alias(sig), F.col("rep").alias(doc))
    pairs = near_sets.unionByName(blocked).join(rep("a", "ra"), "a").join(rep("b", "rb"), "b").filter("ra <> rb")
    return pairs.select(F.least("ra", "rb").alias("doc_a"), F.greatest("ra", "rb").alias("doc_b"), "jaccard").unionByName(equal).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def expand(pairs: DataFrame) -> DataFrame:
    """All pairs of near documents, for whoever wants them in spite of their number, from the rows of ``near``."""
    stars = pairs.filter("jaccard = 1.0")
    member = stars.select(F.col("doc_a").alias("rep"), F.col("doc_b").alias("doc"))
    member = member.unionByName(pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).distinct().join(member.select("doc"), "doc", "left_anti").select(F.col("doc").alias("rep"), "doc"))
    links = pairs.filter("jaccard < 1.0").unionByName(member.select(F.col("rep").alias("doc_a"), F.col("rep").alias("doc_b"), F.lit(1.0).alias("jaccard")).distinct())
    x, y = (member.select(F.col("rep").alias(f"doc_{k}"), F.col("doc").alias(k)) for k in "ab")
    wide = links.join(x, "doc_a").join(y, "doc_b").filter("a <> b and (doc_a <> doc_b or a < b)")
    return wide.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard").distinct()


def groups(pairs: DataFrame) -> DataFrame:
    """Connected groups of pairs (doc_a, doc_b): rows (doc_id, group_id), the group's smallest id.

    Alternates large-star and small-star steps until the edges stand still; each
    step groups and joins edges, and a written table ends its lineage.
    """
    edges = cut(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).filter("u <> v").distinct(), "groups-edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large, "groups-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(edges, "groups-edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("group_id")).distinct())


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **cuts) -> DataFrame:
    """Rows (doc_id, class_id, links), one for each document: smallest id of its connected group, and n-gram sets near its own."""
    signed, reps, near_sets, blocked = _join(docs, Options(n, threshold, **cuts), False)
    both = near_sets.select("a", F.lit(1).cast("bigint").alias("n")).unionByName(near_sets.select(F.col("b").alias("a"), F.lit(1).cast("bigint").alias("n"))).unionByName(blocked.filter("b is null").select("a", "n"))
    links = both.groupBy("a").agg(F.sum("n").alias("links"))
    linked = cut(links.join(reps.select(F.col("sig").alias("a"), F.col("rep").alias("doc_id")), "a").select(F.col("a").alias("sig"), "doc_id", "links"), "jaccard-linked")
    n_linked = linked.count()
    rep = lambda sig, doc: small(linked.select(F.col("sig").alias(sig), F.col("doc_id").alias(doc)), n_linked, 48)
    edges = near_sets.select("a", "b").unionByName(blocked.filter("b is not null").select("a", "b"))
    edges = edges.join(rep("a", "doc_a"), "a").join(rep("b", "doc_b"), "b").select("doc_a", "doc_b")
    # rows of one id with several texts join the groups of all of them
    several = signed.join(reps, "sig").filter("rep <> doc_id").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"))
    merged = groups(edges.unionByName(several)) if _ids_repeat(signed) else groups(edges)
    of_set = reps.select("sig", F.col("rep").alias("doc_id")).join(merged, "doc_id", "left").select("sig", F.coalesce("group_id", "doc_id").alias("class_id"))
    known = signed.select("doc_id", "sig").distinct().join(of_set, "sig").join(linked.select("sig", "links"), "sig", "left")
    known = known.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    every = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    return every.join(known, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _ids_repeat(signed: DataFrame) -> bool:
    """Whether some id has several n-gram sets."""
    return bool(signed.groupBy("doc_id").agg((F.min("sig") < F.max("sig")).alias("two")).filter("two").head(1))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents but those that are in a class with a smaller id, with the columns they came with."""
    gone = cut(classes(docs, **options).filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone")), "jaccard-gone")
    return docs.join(small(gone, gone.count(), 32), docs["doc_id"] == gone["__gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over the whole documents table: (doc_id, class_id, links)."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
