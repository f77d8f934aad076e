"""Rank-safe pruning by score bounds, over a stored index.

A lower bound ``theta`` of each query's k-th score comes from the best postings of
its lists, which are stored apart. The tables of lists, layers and chunks then say
which postings can matter, before any is read; those are scanned once and grouped
once. All of these give the rows of the plain disjunction or conjunction.

An index that isn't stored with the layers that a plan needs is stored first, with
the lists of the queries alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.bm25 import DIGITS
from lexweave.operators import store
from lexweave.operators.index import Index
from lexweave.operators.asked import Asked
from lexweave.operators.asked_layers import Layered
from lexweave.operators.store import Stored
from lexweave.plans import by_document, search
from lexweave.session import cut

#: Slack for rounding: a bound that misses theta by less is kept.
EPS = 2e-6


def kth(scores: DataFrame, k: int) -> DataFrame:
    """Rows (qid, theta) of the k-th best score; queries with fewer have none."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"))
    best = scores.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)
    return best.filter(F.col("at") == k).select("qid", F.col("score").alias("theta"))


def kth_scores(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """The same of whole scores of the queries' documents."""
    if by_document.fits(index, terms):
        return kth(by_document.candidates(index, terms, k), k)
    return kth(search.summed(search.lists(index, terms)), k)


def theta_from(seed: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """theta of the partial sums over some postings (term, doc_id, score): no document scores less than its part."""
    return kth(seed.join(terms, "term").groupBy("qid", "doc_id").agg(F.sum("score").alias("score")), k)


def _at_least(bound: Column) -> Column:
    return F.coalesce(bound >= F.col("theta") - EPS, F.lit(True))


def _wand(index: Stored, terms: DataFrame, theta: DataFrame, k: int) -> DataFrame:
    """A document is ranked if the bounds of the lists that it is in reach theta."""
    bounds = terms.join(index.lists.select("term", F.col("max_score").alias("ub")), "term").join(theta, "qid", "left")
    rows = index.of_terms(terms.select("term")).select("term", "doc_id", "score").join(bounds, "term")
    docs = search.summed(rows, F.sum("ub").alias("bound"), F.first("theta").alias("theta"))
    return search.top(docs.filter(_at_least(F.col("bound"))), k)


def _max_score(index: Stored, terms: DataFrame, theta: DataFrame, k: int, by: tuple[str, ...] = ("term",)) -> DataFrame:
    """Lists (or their layers) by falling bound; those from which on the rest can't reach theta alone give no candidates."""
    ub = terms.join(index.lists if by == ("term",) else index.parts, "term").select("qid", *by, "max_score")
    rest = Window.partitionBy("qid").orderBy(F.desc("max_score"), *by).rowsBetween(0, Window.unboundedFollowing)
    bounds = ub.withColumn("rest", F.sum("max_score").over(rest)).join(theta, "qid", "left").select("qid", *by, _at_least(F.col("rest")).alias("essential"))
    rows = index.of_terms(terms.select("term")).select(*by, "doc_id", "score").join(bounds, list(by))
    return search.top(search.summed(rows, F.max("essential").alias("candidate")).filter("candidate"), k)


def _seeded(index: Asked, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The terms with the bound ``ub`` of each list, and theta, from the best postings of lists that are read by document."""
    best = cut(index.best(), "asked-best")
    bounds = best.groupBy("term").agg(F.max("score").alias("ub"))
    return terms.join(F.broadcast(bounds), "term"), theta_from(best, terms, k)


def _essential(bounds: DataFrame, theta: DataFrame) -> DataFrame:
    """The terms with ``value`` 1 where the lists from this one on, by falling bound, reach theta."""
    rest = Window.partitionBy("qid").orderBy(F.desc("ub"), "term").rowsBetween(0, Window.unboundedFollowing)
    return bounds.withColumn("rest", F.sum("ub").over(rest)).join(theta, "qid", "left").withColumn("value", _at_least(F.col("rest")).cast("int"))


def _told(index: Index, terms: DataFrame, layering: str) -> bool:
    """Whether the index has these layers by document."""
    return isinstance(index, Layered) and index.layering == layering and by_document.fits(index, terms)


def _from_tops(index: Layered, terms: DataFrame, k: int) -> tuple[DataFrame, dict]:
    """The terms with the bound ``ub`` of each list, and theta less slack of each query, from what the top layers hold."""
    ub = [(t, float(u)) for t, u in zip(index.names, index.max_score.max(0))]
    bounds = terms.join(F.broadcast(terms.sparkSession.createDataFrame(ub, "term string, ub double")), "term")
    return bounds, {r.qid: r.theta - EPS for r in kth(by_document.candidates(index, terms, k, layers=1), k).collect()}


def wand(index: Index, terms: DataFrame, k: int = search.K) -> DataFrame:
    if by_document.fits(index, terms):
        bounds, theta = _seeded(index, terms, k)
        least = {r.qid: r.theta - EPS for r in theta.collect()}
        return search.top(by_document.candidates(index, bounds.withColumn("value", F.col("ub")), k, least=least), k)
    index = store.of(index, terms)
    return _wand(index, terms, theta_from(index.best, terms, k), k)


def max_score(index: Index, terms: DataFrame, k: int = search.K) -> DataFrame:
    if by_document.fits(index, terms):
        return search.top(by_document.candidates(index, _essential(*_seeded(index, terms, k)), k), k)
    index = store.of(index, terms)
    return _max_score(index, terms, theta_from(index.best, terms, k), k)


def chunk_skip(index: Index, terms: DataFrame, k: int = search.K) -> DataFrame:
    """Chunks whose best score, with the bounds of all other lists, stays below theta are skipped."""
    index = store.of(index, terms)
    theta = theta_from(index.best, terms, k)
    ub = terms.join(index.lists.select("term", F.col("max_score").alias("ub")), "term")
    others = ub.join(ub.groupBy("qid").agg(F.sum("ub").alias("all")), "qid").join(theta, "qid", "left").select("qid", "term", "theta", (F.col("all") - F.col("ub")).alias("others"))
    kept = index.chunks.select("term", "chunk_no", "max_score").join(others, "term").filter(_at_least(F.col("max_score") + F.col("others"))).select("qid", "term", "chunk_no")
    rows = index.of_terms(terms.select("term")).select("term", "chunk_no", "doc_id", "score").join(kept, ["term", "chunk_no"])
    return search.top(search.summed(rows), k)


def _layered(index: Index, terms: DataFrame, layering: str) -> Stored:
    return store.of(index, terms, layering)


def _tops(index: Stored) -> DataFrame:
    """The top layers: one folder of the store."""
    return index.postings.filter("layer = 0")


def dual_wand(index: Index, terms: DataFrame, k: int = search.K, layering: str | None = None) -> DataFrame:
    """theta from the top layers; then as wand."""
    if _told(index, terms, layering or "percentage_2"):
        bounds, least = _from_tops(index, terms, k)
        return search.top(by_document.candidates(index, bounds.withColumn("value", F.col("ub")), k, least=least), k)
    index = _layered(index, terms, layering or "percentage_2")
    return _wand(index, terms, theta_from(_tops(index).select("term", "doc_id", "score"), terms, k), k)


def dual_max_score(index: Index, terms: DataFrame, k: int = search.K, layering: str | None = None) -> DataFrame:
    if _told(index, terms, layering or "percentage_2"):
        bounds, least = _from_tops(index, terms, k)
        value = _essential(bounds, terms.sparkSession.createDataFrame([(q, t + EPS) for q, t in least.items()], terms.select("qid").schema.add("theta", "double")))
        return search.top(by_document.candidates(index, value, k), k)
    index = _layered(index, terms, layering or "percentage_2")
    return _max_score(index, terms, theta_from(_tops(index).select("term", "doc_id", "score"), terms, k), k)


def multi_or(index: Index, terms: DataFrame, k: int = search.K, layering: str | None = None) -> DataFrame:
    """The disjunction over all disjoint layers."""
    if _told(index, terms, layering or "percentage_8"):
        return search.daat_or(index, terms, k)
    return search.daat_or(_layered(index, terms, layering or "percentage_8"), terms, k)


def multi_max_score(index: Index, terms: DataFrame, k: int = search.K, layering: str | None = None) -> DataFrame:
    """max-score with every layer as a list of its own.

    A document is in one layer of a list at most, so bounds may be counted for each
    layer: that only raises them.
    """
    if _told(index, terms, layering or "percentage_8"):
        theta = {r.qid: r.theta for r in theta_from(index.best(), terms, k).collect()}
        log = by_document.Log(index, terms)
        value = np.zeros((len(log.query), len(index.n)))
        no = np.repeat(np.arange(len(index.names)), np.diff(log.start))
        for q, qid in enumerate(log.qids):
            pair = np.flatnonzero(log.query == q)
            layer, at = np.nonzero(index.n[:, no[pair]])
            order = np.argsort(-index.max_score[layer, no[pair][at]], kind="stable")
            layer, at = layer[order], at[order]
            rest = np.cumsum(index.max_score[layer, no[pair][at]][::-1])[::-1]
            value[pair[at], layer] = rest >= theta.get(qid, -np.inf) - EPS
        return search.top(by_document.candidates(index, terms, k, value=value), k)
    index = _layered(index, terms, layering or "percentage_8")
    return _max_score(index, terms, theta_from(index.best, terms, k), k, ("term", "layer"))


def taat_steps(index: Index, terms: DataFrame, k: int = search.K, layering: str | None = None) -> tuple[Stored, DataFrame, DataFrame]:
    """Layers from the best score down, term at a time: the index, the accumulators left (qid, doc_id), and what each query read.

    Each step adds one layer of the open queries to the accumulators, a written table.
    While what is unread can still lift a new document into the k best, accumulators
    are created; later ones only grow. One that can't reach theta with the bounds of
    the terms it hasn't met is dropped. A query ends with the first step after which
    nothing new can enter and no more than k accumulators are left (so the k best are
    decided), or all lie further apart than what each can still gain (so their ranks
    are, too); its other layers are not read. Rows read: (qid, layers, postings,
    early_terminated, ranked).
    """
    if _told(index, terms, layering or "percentage_8"):
        steps = by_document.Steps(index, terms, k)
        return index, steps.left_over(False), steps.read()
    index = _layered(index, terms, layering or "percentage_8")
    spark = terms.sparkSession
    number = terms.select("qid", "term", (F.row_number().over(Window.partitionBy("qid").orderBy("term")) - 1).alias("no"))
    parts = cut(number.join(index.parts.select("term", "layer", "n", "max_score"), "term"), "taat-parts")
    depth = parts.agg(F.max("layer")).first()[0]
    lists = index.of_terms(terms.select("term")).select("term", "doc_id", "score", "layer")
    done = spark.createDataFrame([], "qid bigint, doc_id bigint")
    told = []
    acc, open_ = None, terms.select("qid").distinct()
    for layer in range((depth if depth is not None else -1) + 1):
        asked = parts.filter(F.col("layer") == layer).join(open_, "qid", "left_semi").select("qid", "term", "no")
        rows = lists.filter(F.col("layer") == layer).join(asked, "term")
        new = rows.select("qid", "doc_id", "score", F.array("no").alias("met"))
        if acc is not None:
            grow = new.join(state.filter("not creates").select("qid"), "qid", "left_semi").join(acc.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")  # noqa: F821
            new = new.join(state.filter("creates").select("qid"), "qid", "left_semi").unionByName(grow).unionByName(acc)  # noqa: F821
        new = new.groupBy("qid", "doc_id").agg(F.sum("score").alias("score"), F.flatten(F.collect_list("met")).alias("met"))
        # what each term's unread layers can still give
        ahead = parts.filter(F.col("layer") > layer).groupBy("qid", "no").agg(F.max("max_score").alias("ub"))
        ahead = ahead.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("no", "ub"))).alias("ubs"), F.sum("ub").alias("left"))
        acc = cut(new, f"taat-acc-{layer}")
        state = cut(open_.join(ahead, "qid", "left").join(kth(acc, k), "qid", "left").withColumn("left", F.coalesce("left", F.lit(0.0))).withColumn("creates", F.col("theta").isNull() | (F.col("left") >= F.col("theta") - EPS)), f"taat-state-{layer}")
        gain = F.col("left") - F.coalesce(F.aggregate("met", F.lit(0.0), lambda a, no: a + F.coalesce(F.try_element_at("ubs", no), F.lit(0.0))), F.lit(0.0))
        acc = acc.join(state.select("qid", "left", "theta", "ubs", "creates"), "qid").withColumn("gain", F.greatest(gain, F.lit(0.0))).filter(F.col("creates") | (F.col("score") + F.col("gain") >= F.col("theta") - EPS))
        above = F.lead("score").over(Window.partitionBy("qid").orderBy("score", "doc_id"))
        acc = cut(acc.withColumn("gap", above - F.col("score")).select("qid", "doc_id", "score", "met", "gain", "gap"), f"taat-kept-{layer}")
        sums = acc.groupBy("qid").agg(F.count("*").alias("held"), F.min(F.coalesce(F.col("gap") > F.col("gain") + EPS, F.lit(True))).alias("apart"))
        sums = state.select("qid", "creates", "left").join(sums, "qid", "left").withColumn("apart", F.coalesce("apart", F.lit(True)))
        last = layer == depth
        verdict = cut(sums.withColumn("ends", F.lit(last) | (F.col("left") == 0) | (~F.col("creates") & ((F.coalesce("held", F.lit(0)) <= k) | F.col("apart")))), f"taat-verdict-{layer}")
        ended = verdict.filter("ends")
        told.append(ended.select("qid", F.lit(layer).alias("last"), (F.col("left") > 0).alias("early_terminated"), F.col("apart").alias("ranked")))
        done = done.unionByName(acc.join(ended.select("qid"), "qid", "left_semi").select("qid", "doc_id"))
        open_ = verdict.filter("not ends").select("qid")
        if not open_.head(1):
            break
        acc = acc.join(open_, "qid", "left_semi").select("qid", "doc_id", "score", "met")
        state = state.join(open_, "qid", "left_semi").select("qid", "creates")
    if not told:
        none = terms.select("qid").distinct().select("qid", F.lit(0).alias("layers"), F.lit(0).cast("bigint").alias("postings"), F.lit(False).alias("early_terminated"), F.lit(True).alias("ranked"))
        return index, done, none
    ends = told[0]
    for t in told[1:]:
        ends = ends.unionByName(t)
    read = ends.join(parts, "qid", "left").filter("layer is null or layer <= last").groupBy("qid", "last", "early_terminated", "ranked").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings"))
    return index, done, read.select("qid", (F.col("last") + 1).alias("layers"), "postings", "early_terminated", "ranked")


def layered_taat(index: Index, terms: DataFrame, k: int = search.K, layering: str | None = None) -> DataFrame:
    """Early-terminated layers, then whole scores of the accumulators that are left."""
    if _told(index, terms, layering or "percentage_8"):
        return search.top(by_document.Steps(index, terms, k).left_over(True), k)
    index, left, _ = taat_steps(index, terms, k, layering)
    rows = index.of_terms(terms.select("term")).select("term", "doc_id", "score").join(terms.select("qid", "term"), "term").join(left, ["qid", "doc_id"], "left_semi")
    return search.top(search.summed(rows), k)


def _dual(index: Stored, terms: DataFrame, k: int, driven: DataFrame) -> DataFrame:
    """Conjunction over the documents of ``driven``, a top layer each; over all where the k-th of them doesn't beat what lies wholly below.

    A document outside every top layer scores at most the sum of the lower
    layers' best scores. Only queries that fail this test read whole lists again.
    """
    rows = index.of_terms(terms.select("term")).select("term", "doc_id", "score").join(terms, "term")
    first = cut(search.conjunction(rows.join(driven, ["qid", "doc_id"], "left_semi")), "dual-first")
    below = terms.join(index.parts.filter("layer > 0").groupBy("term").agg(F.max("max_score").alias("t")), "term").groupBy("qid").agg(F.round(F.sum("t"), DIGITS).alias("below"))
    safe = cut(terms.select("qid").distinct().join(kth(first, k), "qid", "left").join(below, "qid", "left").filter("theta > coalesce(below, 0)").select("qid"), "dual-safe")
    rest = terms.join(safe, "qid", "left_anti")
    out = first.join(safe, "qid", "left_semi")
    if rest.head(1):
        again = index.of_terms(rest.select("term")).select("term", "doc_id", "score").join(rest, "term")
        out = out.unionByName(search.conjunction(again))
    return search.top(out, k)


def dual_and(index: Index, terms: DataFrame, k: int = search.K, layering: str | None = None) -> DataFrame:
    """The top layer of each query's shortest list drives the conjunction; a document of another list's top layer is in the shortest list's lower one."""
    index = _layered(index, terms, layering or "percentage_2")
    shortest = terms.join(index.lists.select("term", "df"), "term").groupBy("qid").agg(F.min(F.struct("df", "term"))["term"].alias("term"))
    tops = _tops(index).select("term", "doc_id").join(terms.select("qid", "term"), "term").select("qid", "doc_id").distinct()
    driven = index.of_terms(shortest.select("term")).select("term", "doc_id").join(shortest, "term").join(tops, ["qid", "doc_id"], "left_semi").select("qid", "doc_id")
    return _dual(index, terms, k, driven)


def dual_merge_and(index: Index, terms: DataFrame, k: int = search.K, layering: str | None = None) -> DataFrame:
    """The union of the top layers drives the conjunction of whole lists; two terms or fewer go the way of dual_and."""
    index = _layered(index, terms, layering or "percentage_2")
    long = terms.filter("n_terms > 2")
    merged = _tops(index).select("term", "doc_id").join(long.select("qid", "term"), "term").select("qid", "doc_id").distinct()
    return _dual(index, long, k, merged).unionByName(dual_and(index, terms.filter("n_terms <= 2"), k, index.layering))
