"""Ranked keyword search: a batch of queries is one plan, whatever their number.

Queries become rows (qid, term); joining them with the postings, grouping by query
and document, and ranking within each query replaces list traversal. The terms
reach the postings as a semi-join before anything is grouped, and only final rows
meet urls and names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text
from lexweave.functions.bm25 import DIGITS
from lexweave.operators.index import Index
from lexweave.operators.store import Stored
from lexweave.plans import by_document

K = 10
CANDIDATES = 200


def query_terms(queries: DataFrame, stop_words: Sequence[str] = (), qid: str = "qid", query: str = "query") -> DataFrame:
    """Rows (qid, term, n_terms) of queries (qid, query)."""
    rows = queries.select(F.col(qid).alias("qid"), text.normalise_query(F.col(query), stop_words).alias("terms"))
    return rows.select("qid", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def short_queries(queries: DataFrame, words: int, qid: str = "qid", query: str = "query") -> DataFrame:
    """The first distinct tokens of each query, as a query log for conjunctive search."""
    return queries.select(F.col(qid).alias("qid"), F.array_join(F.slice(F.array_distinct(text.token_array(F.col(query))), 1, words), " ").alias("query"))


def lists(index: Index, terms: DataFrame) -> DataFrame:
    """Scored postings of the queries: (qid, n_terms, term, doc_id, tf, doc_len, df, idf, avgdl, score)."""
    if isinstance(index, Stored):
        return index.of_terms(terms.select("term")).join(terms, "term")
    return index.scored(index.lookup(terms.select("term"))).join(terms, "term")


def top(scored: DataFrame, k: int) -> DataFrame:
    """Rows (qid, rank from 0, doc_id, score) of the k best, ties by id."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", (F.col("rank") - 1).alias("rank"), "doc_id", "score")


def summed(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.groupBy("qid", "doc_id").agg(F.round(F.sum("score"), DIGITS).alias("score"), *more)


def conjunction(rows: DataFrame) -> DataFrame:
    """Documents that hold all terms of the query."""
    return summed(rows, F.count("*").alias("held"), F.first("n_terms").alias("n_terms")).filter("held = n_terms").select("qid", "doc_id", "score")


def daat_or(index: Index, terms: DataFrame, k: int = K) -> DataFrame:
    if by_document.fits(index, terms):
        return top(by_document.candidates(index, terms, k), k)
    return top(summed(lists(index, terms)), k)


def taat_or(index: Index, terms: DataFrame, k: int = K) -> DataFrame:
    """Accumulators: each term's partial scores are added to what the terms before gave the document."""
    if by_document.fits(index, terms):
        return top(by_document.candidates(index, terms, k), k)
    acc = lists(index, terms).groupBy("qid", "doc_id").agg(F.round(F.sum("score"), DIGITS).alias("score"))
    return top(acc, k)


def daat_and(index: Index, terms: DataFrame, k: int = K) -> DataFrame:
    if by_document.fits(index, terms):
        return top(by_document.candidates(index, terms, k, whole=True), k)
    return top(conjunction(lists(index, terms)), k)


def top_positions(index: Index, terms: DataFrame, k: int = K, candidates: int = CANDIDATES) -> DataFrame:
    """The best conjunctive candidates, re-ranked with the proximity of the terms.

    Each ordered pair of different terms adds idf / distance^2 for every pair of their
    positions; a term's sum is saturated as a frequency is, with weight min(1, idf).
    """
    rows = lists(index, terms)
    best = top(conjunction(rows), max(candidates, k)).select("qid", "doc_id", F.col("score").alias("base"))
    held = rows.join(best, ["qid", "doc_id"]).select("qid", "doc_id", "base", "term", "idf", "doc_len", "avgdl", F.explode("positions").alias("p"))
    other = held.select("qid", "doc_id", F.col("term").alias("term_j"), F.col("p").alias("p_j"))
    pairs = held.join(other, ["qid", "doc_id"]).filter("term <> term_j").withColumn("x", F.col("idf") / F.pow((F.col("p") - F.col("p_j")).cast("double"), F.lit(2.0)))
    acc = pairs.groupBy("qid", "doc_id", "term").agg(F.sum("x").alias("acc"), F.first("idf").alias("idf"), F.first("doc_len").alias("doc_len"), F.first("avgdl").alias("avgdl"))
    bonus = acc.withColumn("b", F.least(F.lit(1.0), F.col("idf")) * F.col("acc") * 3.0 / (F.col("acc") + 0.5 + 1.5 * F.col("doc_len") / F.col("avgdl"))).groupBy("qid", "doc_id").agg(F.sum("b").alias("b"))
    return top(best.join(bonus, ["qid", "doc_id"], "left").select("qid", "doc_id", F.round(F.col("base") + F.coalesce(F.col("b"), F.lit(0.0)), DIGITS).alias("score")), k)


def lexicon_check(index: Index, terms: DataFrame, mode: str = "and") -> DataFrame:
    """Rows (qid, n_terms, n_known, runs): a conjunction runs only if all its terms are known, a disjunction if one is."""
    known = index.lookup(terms.select("term")).select("term").distinct().withColumn("known", F.lit(1))
    q = terms.join(known, "term", "left").groupBy("qid").agg(F.count("*").cast("int").alias("n_terms"), F.coalesce(F.sum("known"), F.lit(0)).cast("int").alias("n_known"))
    return q.withColumn("runs", F.col("n_known") == F.col("n_terms") if mode == "and" else F.col("n_known") > 0)


def match_counts(index: Index, terms: DataFrame, mode: str = "or") -> DataFrame:
    """Rows (qid, n_matches): how many documents hold one term, or all."""
    if by_document.fits(index, terms):
        return by_document.matches(index, terms, mode == "and")
    p = index.lookup(terms.select("term")).join(terms, "term").groupBy("qid", "doc_id").agg(F.count("*").alias("held"), F.first("n_terms").alias("n_terms"))
    p = p.filter("held = n_terms") if mode == "and" else p
    return p.groupBy("qid").agg(F.count("*").alias("n_matches"))


def union_docids(index: Index, terms: DataFrame) -> DataFrame:
    return index.lookup(terms.select("term")).join(terms, "term").select("qid", "doc_id").distinct()


def intersect_docids(index: Index, terms: DataFrame) -> DataFrame:
    return index.lookup(terms.select("term")).join(terms, "term").groupBy("qid", "doc_id").agg(F.count("*").alias("held"), F.first("n_terms").alias("n")).filter("held = n").select("qid", "doc_id")


#: Which index each algorithm needs: layers (0: none, 2: exactly two, 1: any number) and whether they must overlap.
NEEDS: dict[str, tuple[int, bool | None]] = {
    "daat-and": (0, None),
    "daat-or": (0, None),
    "taat-or": (0, None),
    "daat-and-top-positions": (0, None),
    "wand": (0, None),
    "dual-layered-wand": (2, True),
    "max-score": (0, None),
    "dual-layered-max-score": (2, True),
    "max-score-chunk-skip": (0, None),
    "multi-layered-daat-or": (1, False),
    "multi-layered-daat-or-max-score": (1, False),
    "layered-taat-or-early-terminated": (1, False),
    "dual-layered-overlapping-daat": (2, True),
    "dual-layered-overlapping-merge-daat": (2, True),
}


def choose(algorithm: str, layers: int = 1, overlapping: bool = False, positions: bool = False) -> str:
    """The algorithm to run on an index; ``default`` picks one, and an unfit one is refused."""
    if algorithm == "default":
        return "daat-and" if layers == 1 or overlapping else "layered-taat-or-early-terminated"
    if algorithm not in NEEDS:
        raise ValueError(f"unknown query algorithm: {algorithm!r}")
    need, overlap = NEEDS[algorithm]
    if need == 2 and layers != 2:
        raise ValueError(f"{algorithm} needs an index of two layers")
    if need == 1 and layers < 2:
        raise ValueError(f"{algorithm} needs a layered index")
    if overlap is not None and overlapping != overlap:
        raise ValueError(f"{algorithm} needs {'overlapping' if overlap else 'disjoint'} layers")
    if need == 0 and layers > 1 and not overlapping:
        raise ValueError(f"{algorithm} can't run on disjoint layers")
    if algorithm == "daat-and-top-positions" and not positions:
        raise ValueError(f"{algorithm} needs positions")
    return algorithm


def search(index: Index, queries: DataFrame, algorithm: str = "default", k: int = K, stop_words: Sequence[str] = (), layering: str | None = None, overlapping: bool = False) -> DataFrame:
    """Rows (qid, rank, doc_id, score) of queries (qid, query), with any of the named algorithms.

    ``layering`` names the strategy of a layered index; its lists are cut on the fly.
    """
    from lexweave.operators.layers import strategy
    from lexweave.plans import pruning

    name = choose(algorithm, strategy(layering).layers if layering else 1, overlapping, "positions" in index.postings.columns)
    terms = query_terms(queries, stop_words)
    plain: dict[str, Callable] = {"daat-and": daat_and, "daat-or": daat_or, "taat-or": taat_or, "daat-and-top-positions": top_positions, "wand": pruning.wand, "max-score": pruning.max_score, "max-score-chunk-skip": pruning.chunk_skip}
    if name in plain:
        return plain[name](index, terms, k)
    layered: dict[str, Callable] = {"dual-layered-wand": pruning.dual_wand, "dual-layered-max-score": pruning.dual_max_score, "multi-layered-daat-or": pruning.multi_or, "multi-layered-daat-or-max-score": pruning.multi_max_score, "layered-taat-or-early-terminated": pruning.layered_taat, "dual-layered-overlapping-daat": pruning.dual_and, "dual-layered-overlapping-merge-daat": pruning.dual_merge_and}
    return layered[name](index, terms, k, layering)


def named(results: DataFrame, index: Index) -> DataFrame:
    """Results with docno and url, joined to the final rows only."""
    return results.join(index.docs.select("doc_id", "docno", "url"), "doc_id", "left")


def format_results(results: DataFrame, index: Index, fmt: str = "normal", run: str = "run", queries: DataFrame | None = None) -> DataFrame:
    """Rows (qid, rank, line). normal: score, id, url; trec: qid Q0 docno rank score run; compare: query, count, then score and id; discard: nothing."""
    score = F.format_string("%.6f", "score")
    if fmt == "discard":
        return results.limit(0).select("qid", "rank", F.lit("").alias("line"))
    if fmt == "normal":
        return named(results, index).select("qid", "rank", F.concat_ws("\t", score, F.col("doc_id").cast("string"), F.coalesce("url", F.lit(""))).alias("line"))
    if fmt == "trec":
        return named(results, index).select("qid", "rank", F.concat_ws("\t", F.col("qid").cast("string"), F.lit("Q0"), "docno", F.col("rank").cast("string"), score, F.lit(run)).alias("line"))
    if fmt == "compare":
        lines = results.select("qid", "rank", F.concat_ws("\t", score, F.col("doc_id").cast("string")).alias("line"))
        count = results.groupBy("qid").agg(F.count("*").alias("n"))
        head = (queries.select("qid", "query") if queries is not None else count.select("qid", F.lit("").alias("query"))).join(count, "qid", "left")
        head = head.select("qid", F.lit(-1).alias("rank"), F.concat_ws("\t", "query", F.coalesce("n", F.lit(0)).cast("string")).alias("line"))
        return head.unionByName(lines)
    raise ValueError(f"unknown result format: {fmt!r}")


def bench_search(run: Callable[[], DataFrame], warm_ups: int = 1, repeats: int = 3) -> dict[str, float]:
    """Seconds of a search written to no sink, after runs that aren't timed."""
    seconds = []
    for i in range(warm_ups + repeats):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        if i >= warm_ups:
            seconds.append(time.perf_counter() - began)
    return {"runs": len(seconds), "total_s": sum(seconds), "mean_s": sum(seconds) / len(seconds), "best_s": min(seconds)}


def query_metrics(index: Index, terms: DataFrame) -> DataFrame:
    """Rows (qid, n_terms, n_postings, n_matches): what each query reads and finds."""
    p = index.lookup(terms.select("term")).join(terms, "term")
    per_doc = p.groupBy("qid", "doc_id").agg(F.count("*").alias("held"))
    found = per_doc.groupBy("qid").agg(F.sum("held").alias("n_postings"), F.count("*").alias("n_matches"))
    return terms.groupBy("qid").agg(F.count("*").alias("n_terms")).join(found, "qid", "left").fillna(0, ["n_postings", "n_matches"])
