"""Benchmark decontamination with a distributed positional inverted index.

``build`` stores the postings of every training token: the corpus is cut into
blocks of whole documents, and each block holds, sorted by term key, the positions
at which the term stands. A document lies in one block, so blocks are searched
independently and nothing is shuffled. ``match`` sends the test items to the blocks:

* exact: an alignment of item and document at which NGRAM consecutive words agree
  (the whole item, if shorter). Each word window starts from its rarest term in
  the block; the lists of the others, shifted by their offsets and taken from the
  rarest on, are intersected with it. Windows of one alignment that overlap are
  reported as one run.
* proximity: a stretch of at most SLACK times the item's words that holds at least
  SHARE of its distinct terms, rounded up, in any order; of a document the best
  stretch is given, of equal ones the first. Such a stretch has one of the rarest
  terms, so candidates come from the shortest lists alone. The rule is one for items
  of all sizes: of up to four terms all are needed.

Words are those of ``_words`` and agree when their 64-bit keys do.

Defined results: rows and items without id are left out; null, empty and wordless
texts match nothing; a very long text is a block of its own and searched whole;
repeated rows and items each match for themselves, equal result rows are given once;
an empty table gives an empty result; other columns are not read by ``match`` and
pass through ``clean`` untouched, whatever their names.

The test items go to every task. Their size is checked: above ``max_item_words``
words they are sent in several passes of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm._words import lean, slices, words
from lexweave.session import cut, ship, small, work_path

NGRAM = 13
SHARE = 0.8
SLACK = 1.5
MAX_ITEM_WORDS = 500_000
#: A block is closed at so many bytes of text; long documents make longer blocks.
BLOCK_BYTES = 4 << 20

INDEX = "ids binary, first binary, terms binary, starts binary, postings binary"
MATCHES = "doc_id bigint, item_id bigint, match string, position bigint, n_words bigint"


def _block(ids: np.ndarray, texts: pa.Array) -> list[bytes]:
    w = words(texts)
    order = np.argsort(w.hash, kind="stable")
    key = w.hash[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.append(np.flatnonzero(new), len(key))
    gaps = np.diff(order.astype(np.int64), prepend=0)
    gaps[starts[:-1]] = order[starts[:-1]]
    return [ids.astype(np.int64).tobytes(), w.first.astype(np.int64).tobytes(), key[new].tobytes(), starts.astype(np.int64).tobytes(), gaps.astype(np.uint32).tobytes()]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["ids", "first", "terms", "starts", "postings"]
    for b in batches:
        ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        for i, j in slices(texts, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in _block(ids[i:j], texts[i:j])], names)


def build(docs: DataFrame) -> DataFrame:
    """The stored index of all tokens, one row a block, in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    path = work_path(spark, "postings")
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    rows.mapInArrow(lean(_index), INDEX).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(INDEX).parquet(path)


class _Items:
    """Test items as indices into their sorted vocabulary."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = words(pa.array(texts, pa.string()))
        self.vocab, term = np.unique(w.hash, return_inverse=True)
        self.rows = [(i, term[a:b]) for i, a, b in zip(ids, w.first[:-1].tolist(), w.first[1:].tolist()) if b > a]


class Lists:
    """Posting lists of the test vocabulary in one block."""

    def __init__(self, block: dict[str, bytes], vocab: np.ndarray):
        self.ids, self.first = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["first"], np.int64)
        terms, starts, gaps = np.frombuffer(block["terms"], np.uint64), np.frombuffer(block["starts"], np.int64), np.frombuffer(block["postings"], np.uint32)
        at = np.searchsorted(terms, vocab)
        at[at == len(terms)] = 0
        there = terms[at] == vocab if len(terms) else np.zeros(len(vocab), bool)
        self.df = np.where(there, np.diff(starts)[at], 0) if len(terms) else np.zeros(len(vocab), np.int64)
        self._at, self._starts, self._gaps, self._open = at, starts, gaps, {}

    def of(self, term: int) -> np.ndarray:
        """Ascending positions of a term."""
        if term not in self._open:
            s = self._starts[self._at[term]]
            self._open[term] = np.cumsum(self._gaps[s : s + self.df[term]], dtype=np.int64)
        return self._open[term]

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1


def _has(sorted_list: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, values)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == values


def exact(lists: Lists, item: np.ndarray, ngram: int) -> set[tuple[int, int, int]]:
    """(doc index, first position, words) of the runs of ``ngram`` or more agreeing words."""
    m = len(item)
    n = min(ngram, m)
    df = lists.df[item]
    gone = np.concatenate([[0], np.cumsum(df == 0)])
    anchors: dict[int, list[int]] = {}
    for s in np.flatnonzero(gone[n:] == gone[: m - n + 1]).tolist():
        anchors.setdefault(s + int(df[s : s + n].argmin()), []).append(s)
    hits = []
    for j, windows in anchors.items():
        at = lists.of(item[j]) - j
        w = np.array(windows)
        alive = np.ones((len(at), len(w)), bool)
        offsets = [k for k in range(w[0], w[-1] + n) if k != j]
        for k in sorted(offsets, key=lambda k: df[k]):
            if not len(at):
                break
            inside = (w <= k) & (k < w + n)
            if df[k]:
                alive &= _has(lists.of(item[k]), at + k)[:, None] | ~inside
            else:
                alive &= ~inside
            left = alive.any(1)
            at, alive = at[left], alive[left]
        if len(at):
            a, s = np.nonzero(alive)
            hits.append(np.stack([at[a], w[s]], 1))
    if not hits:
        return set()
    found = np.unique(np.concatenate(hits), axis=0)
    start = found[:, 0] + found[:, 1]
    found = found[lists.doc(start) == lists.doc(start + n - 1)]
    out = set()
    run: list[int] | None = None
    for a, s in found.tolist():
        if run and run[0] == a and s == run[2] + 1:
            run[2] = s
        else:
            if run:
                out.add((run[0] + run[1], run[2] - run[1] + n))
            run = [a, s, s]
    if run:
        out.add((run[0] + run[1], run[2] - run[1] + n))
    return {(int(lists.doc(np.array([p]))[0]), p, c) for p, c in out}


def near(lists: Lists, item: np.ndarray, share: float, slack: float) -> set[tuple[int, int, int]]:
    """(doc index, first position, terms) of the best stretch of each document that holds enough of the item's terms."""
    terms = np.unique(item)
    u = len(terms)
    need, span = ceil(round(share * u, 9)), ceil(round(slack * len(item), 9))
    terms = terms[np.argsort(lists.df[terms], kind="stable")]
    df = lists.df[terms]
    if (df > 0).sum() < need:
        return set()
    seeds = [lists.of(t) for t, d in zip(terms[: u - need + 1], df) if d]
    if not seeds:
        return set()
    at = np.unique(np.concatenate(seeds))
    found = np.zeros(len(at), np.int64)
    for k, t in enumerate(terms):
        if df[k]:
            p = lists.of(t)
            i = np.searchsorted(p, at - span + 1)
            i[i == len(p)] = len(p) - 1
            found += np.abs(p[i] - at) < span
        left = found + (u - 1 - k) >= need
        at, found = at[left], found[left]
        if not len(at):
            return set()
    out: dict[int, tuple[int, int]] = {}
    for d in np.unique(lists.doc(at)).tolist():
        lo, hi = lists.first[d], lists.first[d + 1]
        mine = at[(at >= lo) & (at < hi)]
        lo, hi = max(lo, int(mine[0]) - span + 1), min(hi, int(mine[-1]) + span)
        spots, kinds = [], []
        for k, t in enumerate(terms):
            if df[k]:
                p = lists.of(t)
                p = p[np.searchsorted(p, lo) : np.searchsorted(p, hi)]
                spots.append(p)
                kinds.append(np.full(len(p), k))
        spot, kind = np.concatenate(spots), np.concatenate(kinds)
        order = np.argsort(spot)
        spot, kind = spot[order].tolist(), kind[order].tolist()
        held, distinct, a, best = [0] * u, 0, 0, (0, 0)
        for b in range(len(spot)):
            distinct += held[kind[b]] == 0
            held[kind[b]] += 1
            while spot[b] - spot[a] >= span:
                held[kind[a]] -= 1
                distinct -= held[kind[a]] == 0
                a += 1
            if distinct > best[0]:
                best = (distinct, spot[a])
        if best[0] >= need:
            out[d] = (best[1], best[0])
    return {(d, p, c) for d, (p, c) in out.items()}


def _search(items: _Items, ngram: int, share: float, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                lists = Lists({n: b.column(i)[r].as_buffer() for i, n in enumerate(b.schema.names)}, items.vocab)
                rows = []
                for item_id, item in items.rows:
                    for kind, hits in (("exact", exact(lists, item, ngram)), ("proximity", near(lists, item, share, slack))):
                        rows += [(int(lists.ids[d]), item_id, kind, int(p - lists.first[d]), c) for d, p, c in hits]
                if rows:
                    cols = list(zip(*sorted(set(rows))))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["doc_id", "item_id", "match", "position", "n_words"])

    return run


def match(index: DataFrame, items: DataFrame, ngram: int = NGRAM, share: float = SHARE, slack: float = SLACK, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """Rows (doc_id, item_id, match, position, n_words): position counts the document's words from 0; n_words is the length of an exact run, or the distinct terms of a stretch."""
    ship(index.sparkSession)
    items = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    passes = max(1, ceil(size / max_item_words))
    out = None
    for k in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        found = index.mapInArrow(lean(_search(_Items([r.item_id for r in rows], [r.text for r in rows]), ngram, share, slack)), MATCHES)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any match, with the columns they came with; rows without id stay."""
    hit = cut(match(build(docs), items, **options).select(F.col("doc_id").alias("__hit")).distinct(), "decontaminate-hit")
    return docs.join(small(hit, hit.count(), 32), docs["doc_id"] == hit["__hit"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over the whole documents and benchmark tables."""
    return match(build(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
