"""Exact top-k search by exhaustive term-at-a-time accumulation.

Every query row meets every document. A block of documents becomes weighted
postings (BM25); each query is a sparse row of term weights whose terms scatter
their postings into a dense array of scores, one slot for each document of the
block, term after term. Partition selection takes the best k of each array, a
task merges its blocks, and a last grouped step merges the tasks.

Scores are rounded to six decimals before they are ranked; documents of equal score are
ranked by id. A query has fewer than k rows where fewer documents share a term.

Defined results: documents without id are left out of results and statistics;
null, empty and wordless texts have length 0 and score nothing, and count as
documents; very long texts are scored whole; documents that repeat an id are documents of their own; queries without id
or words have no rows; equal query rows are one query, queries of one id with
different texts are ranked each; an empty table gives an empty result; other
columns are not read, whatever their names.

The queries go to every task. Their size is checked: above ``max_query_words``
words they are answered in several passes of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm._words import lean, slices, words
from lexweave.session import ship

K = 10
K1, B = 1.2, 0.75
#: Ids of documents that ask for others like them are divisible by this.
EVERY = 50
MAX_QUERY_WORDS = 200_000
#: Score slots (queries x documents) that a task holds at once.
SLOTS = 4_000_000


def _postings(texts: pa.Array, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term, document and frequency of each posting, by term; and the lengths of all texts."""
    w = words(texts)
    at = np.searchsorted(vocab, w.hash)
    at[at == len(vocab)] = 0
    hit = vocab[at] == w.hash
    key, tf = np.unique(at[hit] * np.int64(len(texts)) + w.doc[hit], return_counts=True)
    return key // len(texts), key % len(texts), tf, np.diff(w.first)


def _statistics(vocab: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(vocab), np.int64), 0, 0
        for b in batches:
            for i, j in slices(b.column(1)):
                term, _, _, length = _postings(b.column(1)[i:j], vocab)
                df += np.bincount(term, minlength=len(vocab))
                n, total = n + j - i, total + int(length.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1, -2]), pa.array(np.r_[df[some], n, total])], ["term", "n"])

    return run


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Slots of the k best positive scores, ties by id: a partition, then a sort of what it leaves."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        slots = np.flatnonzero((scores >= limit) & (scores > 0))
    else:
        slots = np.flatnonzero(scores > 0)
    return slots[np.lexsort((ids[slots], -scores[slots]))[:k]]


def _score(queries: list[tuple[int, np.ndarray, np.ndarray]], vocab: np.ndarray, idf: np.ndarray, average: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
        for b in batches:
            for i, j in slices(b.column(1)):
                ids = b.column(0)[i:j].to_numpy(zero_copy_only=False)
                term, doc, tf, length = _postings(b.column(1)[i:j], vocab)
                weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / average))
                edge = np.searchsorted(term, np.arange(len(vocab) + 1)).tolist()
                wide = max(1, SLOTS // (j - i))
                for q in range(0, len(queries), wide):
                    part = queries[q : q + wide]
                    scores = np.zeros((len(part), j - i))
                    for row, (_, terms, times) in zip(scores, part):
                        for t, c in zip(terms.tolist(), times.tolist()):
                            a, z = edge[t], edge[t + 1]
                            if a < z:
                                row[doc[a:z]] += c * weight[a:z]
                    scores = np.round(scores, 6)
                    for r, row in enumerate(scores):
                        s = select(row, ids, k)
                        if len(s):
                            have = np.concatenate([best[q + r][0], row[s]]), np.concatenate([best[q + r][1], ids[s]])
                            o = select(have[0], have[1], k)
                            best[q + r] = have[0][o], have[1][o]
        rows = [(n, queries[n][0], s, d) for n, (score, doc) in enumerate(best) for s, d in zip(score.tolist(), doc.tolist())]
        if rows:
            n, q, s, d = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], ["row", "item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = K, max_query_words: int = MAX_QUERY_WORDS) -> DataFrame:
    """Rows (item_id, rank from 1, doc_id, score)."""
    ship(docs.sparkSession)
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = queries.filter("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    size = asked.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    passes = max(1, ceil(size / max_query_words))
    out = None
    for p in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).orderBy("item_id", "text").collect()
        w = words(pa.array([r.text for r in part], pa.string()))
        vocab, index = np.unique(w.hash, return_inverse=True)
        if not len(vocab):
            vocab = np.zeros(1, np.uint64)
        sparse = [(r.item_id, *np.unique(index[a:b], return_counts=True)) for r, a, b in zip(part, w.first[:-1], w.first[1:])]
        counted = {r.term: r.n for r in rows.mapInArrow(lean(_statistics(vocab)), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, total = counted.pop(-1, 0), counted.pop(-2, 0)
        df = np.zeros(len(vocab))
        for t, c in counted.items():
            df[t] = c
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        found = rows.mapInArrow(lean(_score(sparse, vocab, idf, max(total / max(n, 1), 1e-9), k)), "row bigint, item_id bigint, doc_id bigint, score double").withColumn("pass", F.lit(p))
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("pass", "row").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every benchmark row as a query against the whole documents table."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def query_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 with documents as queries: every one whose id is divisible by EVERY, whole, against the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, docs.filter(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("item_id"), "text"))


SQL = rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS term FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY ALL),
s AS (SELECT (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS n, (SELECT count(*) FROM t) AS total),
f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS term FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, round(sum(times * (ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * len / (CAST(total AS DOUBLE) / n))))), 6) AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc_id) CROSS JOIN s GROUP BY item_id, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r)
SELECT * FROM k WHERE rank <= {K}"""
SQL_BY_DOCUMENT = SQL.replace("FROM benchmark)", f"FROM (SELECT doc_id AS item_id, text FROM documents WHERE doc_id % {EVERY} = 0))")
