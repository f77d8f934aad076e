"""The lists of asked terms alone, with a row for each document.

A search whose terms are known asks for a small part of an index. Texts are read once,
for these terms; a row has a document's length and its frequencies of them, so that
what adds up by document needs no shuffle, and the rows of all documents give the
statistics of the collection.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import bm25, text
from lexweave.operators.index import Index, build
from lexweave.session import cut, ship

#: Postings of a list that are told as its best ones.
BEST = 64


def flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (doc_id, doc_len, nos, tfs): lengths, each posting's row, term number and frequency."""
    nos, tfs = b.column(2), b.column(3)
    row = np.repeat(np.arange(b.num_rows), nos.value_lengths().to_numpy(zero_copy_only=False))
    return b.column(1).to_numpy(zero_copy_only=False), row, nos.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _counts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, cf, docs, total = np.zeros(n, np.int64), np.zeros(n, np.int64), 0, 0
        for b in batches:
            length, _, no, tf = flat(b)
            df += np.bincount(no, minlength=n)
            np.add.at(cf, no, tf)
            docs, total = docs + b.num_rows, total + int(length.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, held].astype(np.int32)), pa.array(np.r_[docs, df[held]]), pa.array(np.r_[total, cf[held]])], ["no", "df", "cf"])

    return run


def score(tf: np.ndarray, doc_len: np.ndarray, idf: np.ndarray, avgdl: float) -> np.ndarray:
    """bm25.partial of arrays."""
    return idf * tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B) + bm25.K1 * bm25.B / avgdl * doc_len)


def _best(idf: np.ndarray, avgdl: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, doc, value = np.zeros(0, np.int64), None, np.zeros(0)
        for b in batches:
            length, row, n, tf = flat(b)
            ids = b.column(0).take(pa.array(row))
            no, value, doc = np.r_[no, n], np.r_[value, score(tf, length[row], idf[n], avgdl)], ids if doc is None else pa.concat_arrays([doc, ids])
            order = np.lexsort((-value, no))
            start = np.flatnonzero(np.r_[True, np.diff(no[order]) != 0]) if len(no) else order
            place = np.arange(len(no)) - np.repeat(start, np.diff(np.append(start, len(no))))
            order = order[place < BEST]
            no, value, doc = no[order], value[order], doc.take(pa.array(order))
        if len(no):
            yield pa.RecordBatch.from_arrays([pa.array(no.astype(np.int32)), doc, pa.array(value)], ["no", "doc_id", "score"])

    return run


@dataclass(frozen=True, eq=False)
class Asked(Index):
    """An index of some terms: forward (doc_id, doc_len, nos, tfs) has all documents; names, df and cf are by term number."""

    forward: DataFrame = None
    names: tuple[str, ...] = ()
    df: np.ndarray = None
    cf: np.ndarray = None
    n_docs: int = 0
    total_len: int = 0

    @property
    def avgdl(self) -> float:
        return max(1.0, float(self.total_len // max(self.n_docs, 1)))

    @property
    def stats(self) -> DataFrame:
        return self.forward.sparkSession.range(1).select(F.lit(self.n_docs).cast("bigint").alias("n_docs"), F.lit(self.total_len).cast("bigint").alias("total_len"), F.lit(self.avgdl).alias("avgdl"))

    @property
    def lexicon(self) -> DataFrame:
        rows = [(t, int(a), int(b)) for t, a, b in zip(self.names, self.df, self.cf) if a]
        return self.forward.sparkSession.createDataFrame(rows, "term string, df bigint, cf bigint")

    @property
    def idf(self) -> np.ndarray:
        return np.log10(1 + (self.n_docs - self.df + 0.5) / (self.df + 0.5))

    def scored(self, postings: DataFrame | None = None) -> DataFrame:
        return self.scored_with(self.postings if postings is None else postings, F.broadcast(self.lexicon.select("term", "df")))

    def best(self) -> DataFrame:
        """Rows (term, doc_id, score): the best postings that a task has of a list, with all that are best of it."""
        kind = self.forward.schema["doc_id"].dataType.simpleString()
        rows = self.forward.mapInArrow(_best(self.idf, self.avgdl), f"no int, doc_id {kind}, score double")
        return rows.join(F.broadcast(_named(self.forward, self.names)), "no").select("term", "doc_id", "score")


def _named(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(names)), "no int, term string")


def read(df: DataFrame, names: Sequence[str], key: str = "doc_id", body: str = "text") -> Asked:
    """Index a table of plain texts for some terms."""
    ship(df.sparkSession)
    names = tuple(sorted(set(names)))
    rows = df.filter(F.col(key).isNotNull())
    forward = cut(text.frequencies(rows, key, F.col(body), names), "asked")
    counts = forward.mapInArrow(_counts(len(names)), "no int, df bigint, cf bigint").groupBy("no").agg(F.sum("df"), F.sum("cf")).collect()
    told = {r[0]: (r[1], r[2]) for r in counts}
    n_docs, total_len = told.pop(-1, (0, 0))
    both = np.array([told.get(i, (0, 0)) for i in range(len(names))], np.int64).reshape(-1, 2)
    zipped = forward.select("doc_id", "doc_len", F.explode(F.arrays_zip("nos", "tfs")).alias("p"))
    postings = zipped.select(F.col("p.nos").alias("no"), "doc_id", F.col("p.tfs").cast("bigint").alias("tf"), "doc_len").join(F.broadcast(_named(df, names)), "no").select("term", "doc_id", "tf", "doc_len")
    return Asked(postings, build(df, key, body).docs, False, forward, names, both[:, 0], both[:, 1], n_docs, total_len)
