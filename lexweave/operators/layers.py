"""Layers of a list: slices in falling score order.

A list's boundaries follow from its length and from where runs of equal scores
end. The latter are one small sorted array a term (scores are rounded, so their
number is bounded), and the boundaries are at most eight steps over it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import bm25
from lexweave.functions.bm25 import DIGITS
from lexweave.operators.index import Index
from lexweave.operators.ranks import RANGE, _starts, numbered
from lexweave.session import cut, ship

LEAST = 128
MAX_LAYERS = 8


@dataclass(frozen=True)
class Strategy:
    """Shares in percent, or (exponential) none; least and most postings a layer, 0 for no limit."""

    layers: int
    shares: tuple[float, ...] = ()
    least: tuple[int, ...] = ()
    most: tuple[int, ...] = ()
    #: First two lower bounds of exponential layers; each further one is the sum of the two before.
    steps: tuple[int, int] = (16384, 32768)


STRATEGIES = {
    "equal_2": Strategy(2, (50.0,) * 2),
    "equal_4": Strategy(4, (25.0,) * 4),
    "equal_8": Strategy(8, (12.5,) * 8),
    "percentage_2": Strategy(2, (25.0, 75.0)),
    "percentage_4": Strategy(4, (6.25, 18.75, 18.75, 56.25)),
    "percentage_8": Strategy(8, (1.5625, 4.6875, 4.6875, 4.6875, 14.0625, 14.0625, 14.0625, 42.1875)),
    "exponential_2": Strategy(2, least=(32768,) * 2),
    "exponential_4": Strategy(4, least=(32768,) * 4),
    "exponential_8": Strategy(8, least=(32768,) * 8),
    "percentage-lower-bounded": Strategy(6, (5.0, 5.0, 10.0, 15.0, 25.0, 40.0), least=(1024, 2048, 4096, 8192, 16384, 32768)),
    "percentage-lower-upper-bounded": Strategy(6, (5.0, 5.0, 10.0, 15.0, 25.0, 40.0), least=(1024, 2048, 4096, 8192, 16384, 32768), most=(1024, 8192, 0, 0, 0, 0)),
    "exponentially-increasing": Strategy(8, least=(1024,) * 8),
}


def strategy(name: str | Strategy, num_layers: int | None = None) -> Strategy:
    s = name if isinstance(name, Strategy) else STRATEGIES.get(name)
    if s is None:
        raise ValueError(f"unknown layering strategy: {name!r}")
    if num_layers is not None and num_layers != s.layers:
        if s.shares or not 1 <= num_layers <= MAX_LAYERS:
            raise ValueError(f"{name} has {s.layers} layers")
        return Strategy(num_layers, least=(s.least * MAX_LAYERS)[:num_layers], steps=s.steps)
    return s


def _size(s: Strategy, i: int, n: Column) -> Column:
    if s.shares:
        size = F.floor(F.lit(s.shares[i] / 100.0) * n)
        if s.most and s.most[i]:
            size = F.least(size, F.lit(s.most[i]))
    else:
        base = F.pow(n.cast("double"), F.lit(1.0 / s.layers))
        size = F.floor((base - 1.0) * F.pow(base, F.lit(float(i))))
        low = [s.steps[0], s.steps[1]]
        while len(low) <= i:
            low.append(low[-1] + low[-2])
        size = F.greatest(size, F.lit(low[i]))
        if s.least and s.least[i]:
            size = F.greatest(size, F.lit(s.least[i]))
    return size.cast("bigint")


def _count(s: Strategy, i: int, n: int) -> int:
    """``_size`` of a number."""
    if s.shares:
        size = math.floor(s.shares[i] / 100.0 * n)
        return min(size, s.most[i]) if s.most and s.most[i] else size
    base = math.pow(n, 1.0 / s.layers)
    low = [s.steps[0], s.steps[1]]
    while len(low) <= i:
        low.append(low[-1] + low[-2])
    return max(math.floor((base - 1.0) * math.pow(base, i)), low[i], s.least[i] if s.least else 0)


def starts(n: np.ndarray, s: Strategy) -> tuple[int, ...]:
    """``boundaries`` of one list, whose runs of equal scores have these lengths."""
    ends, start, out = np.cumsum(n), 0, []
    total = int(ends[-1])
    for i in range(s.layers):
        left = total - start
        if left <= 0:
            break
        out.append(start)
        size = min(_count(s, i, total), left)
        size = LEAST if size < LEAST <= left else size
        end = total if i == s.layers - 1 or left - size < size else start + size
        if end < total:
            end = max(end, int(ends[np.searchsorted(ends, start, "right")]))
        start = end
    return tuple(out)


def boundaries(scored: DataFrame, s: Strategy, digits: int = DIGITS) -> DataFrame:
    """Rows (term, starts): rank at which each layer of the list starts."""
    runs = scored.groupBy("term", F.round("score", digits).alias("score")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("term").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ends = runs.withColumn("end", F.sum("n").over(down)).groupBy("term").agg(F.array_sort(F.collect_list("end")).alias("ends"), F.max("end").alias("n"))
    out = ends.withColumn("start", F.lit(0).cast("bigint")).withColumn("starts", F.array().cast("array<bigint>"))
    for i in range(s.layers):
        last = i == s.layers - 1
        left = F.col("n") - F.col("start")
        size = F.least(_size(s, i, F.col("n")), left)
        size = F.when((size < LEAST) & (left >= LEAST), F.lit(LEAST)).otherwise(size)
        size = left if last else F.when(left - size < size, left).otherwise(size)
        out = out.withColumn("starts", F.when(left > 0, F.concat("starts", F.array("start"))).otherwise(F.col("starts"))).withColumn("end", F.col("start") + size)
        if not last:
            # equal scores may not straddle two layers
            tie = F.element_at(F.filter("ends", lambda e: e > F.col("start")), 1)
            out = out.withColumn("end", F.when((left > 0) & (F.col("end") < F.col("n")), F.greatest("end", tie)).otherwise(F.col("end")))
        out = out.withColumn("start", F.col("end")).drop("end")
    return out.select("term", "starts")


def layerify(scored: DataFrame, name: str | Strategy = "percentage_2", num_layers: int | None = None, overlapping: bool = False, digits: int = DIGITS) -> DataFrame:
    """Postings with ``layer`` (0 has the best scores); overlapping layers repeat all better postings."""
    ranked = numbered(scored.withColumn("rounded", F.round("score", digits)), "term", [F.desc("rounded"), "doc_id"], rank="rank")
    return assign(ranked, name, num_layers, overlapping, digits)


def assign(ranked: DataFrame, name: str | Strategy, num_layers: int | None = None, overlapping: bool = False, digits: int = DIGITS) -> DataFrame:
    """The same of postings with their ``rank`` in the list (and the ``rounded`` score that it follows)."""
    joined = ranked.join(boundaries(ranked, strategy(name, num_layers), digits), "term")
    layer = F.size(F.filter("starts", lambda x: x <= F.col("rank"))) - 1
    rows = joined.withColumn("layer", layer)
    if overlapping:
        rows = rows.withColumn("layer", F.explode(F.sequence(F.col("layer"), F.size("starts") - 1)))
    return rows.drop("starts", "rounded", "rank")


def layer_stats(layers: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Rows (term, layer, n, score_threshold): the best score of what a layer adds to those before it."""
    new = layers.groupBy("term", "doc_id").agg(F.min("layer").alias("layer"), F.max(F.round("score", digits)).alias("score")).groupBy("term", "layer").agg(F.max("score").alias("score_threshold"))
    return layers.groupBy("term", "layer").agg(F.count("*").alias("n")).join(new, ["term", "layer"])


def df_of(parts: DataFrame, overlapping: bool = False) -> DataFrame:
    """Rows (term, df) of whole lists from their layers (term, layer, n): the last of overlapping ones holds all."""
    return parts.groupBy("term").agg((F.max("n") if overlapping else F.sum("n")).alias("df"))


#: Postings of short lists that are ranked in one go.
BLOCK = 1 << 17


def _within(s: Strategy, n_docs: int, avgdl: float) -> Callable:
    """Sorted batches (term, doc_id, tf, doc_len) of a range, with score, layer and the number of the list's layers; no layer for the first and the last list of the range."""
    def ranked(b: pa.RecordBatch, edge: list[str], short: Callable) -> pa.RecordBatch:
        new = np.flatnonzero(_starts(b.column(0), None))
        df = np.diff(np.append(new, b.num_rows))
        names = b.column(0).take(pa.array(new)).to_pylist()
        group = np.repeat(np.arange(len(new)), df)
        doc, tf, length = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        idf = np.log10(1 + (n_docs - df + 0.5) / (df + 0.5))[group]
        score = idf * tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B) + bm25.K1 * bm25.B / avgdl * length)
        points = np.floor(score * 10**DIGITS + 0.5)
        order = np.lexsort((doc, -points, group))
        run = np.flatnonzero(np.r_[True, (group[order][1:] != group[order][:-1]) | (points[order][1:] != points[order][:-1])])
        runs = np.diff(np.append(run, b.num_rows))
        first = np.searchsorted(run, np.append(new, b.num_rows))
        layer, of = np.zeros(b.num_rows, np.int32), np.ones(b.num_rows, np.int32)
        for g, name in enumerate(names):
            lo, hi = int(new[g]), int(new[g] + df[g])
            if name in edge:
                layer[lo:hi] = -1
            elif hi - lo > 1:
                n = runs[first[g] : first[g + 1]]
                at = short(tuple(n.tolist())) if len(n) <= 64 else starts(n, s)
                if len(at) > 1:
                    layer[order[lo:hi]] = np.searchsorted(at, np.arange(hi - lo), "right") - 1
                    of[lo:hi] = len(at)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array(layer), pa.array(of)], [*b.schema.names, "score", "layer", "layers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = lru_cache(1 << 16)(lambda n: starts(np.array(n), s))
        first, held, rows, enough = None, [], 0, BLOCK
        for b in batches:
            if not b.num_rows:
                continue
            first = b.column(0)[0].as_py() if first is None else first
            held.append(b)
            rows += b.num_rows
            if rows < enough:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = int(np.flatnonzero(_starts(whole.column(0), None))[-1])
            if last:
                yield ranked(whole.slice(0, last), [first], short)
            elif whole.column(0)[0].as_py() == first:  # the list of the range's start: left as it is, not held
                yield ranked(whole, [first], short)
                last = rows
            held, rows = ([whole.slice(last)], rows - last) if last < rows else ([], 0)
            enough = max(BLOCK, 2 * rows)
        if rows:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield ranked(whole, [first, whole.column(0)[rows - 1].as_py()], short)

    return run


def layers_of(index: Index, name: str | Strategy, overlapping: bool = False) -> DataFrame:
    """Rows (term, layer, doc_id, tf, score) of a whole index, as ``layerify`` of its scored postings.

    A list that one range holds is scored and ranked there; those at a range's ends are
    ranked over all.
    """
    s = strategy(name)
    rows = cut(index.postings.select("term", "doc_id", "tf", "doc_len"), "postings")
    spark = rows.sparkSession
    ship(spark)
    stats = index.stats.first()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE)
    ranges = rows.repartitionByRange(parts, "term", "doc_id").sortWithinPartitions("term", "doc_id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    told = cut(ranges.mapInArrow(_within(s, stats.n_docs, stats.avgdl), f"{kinds}, score double, layer int, layers int"), "layers")
    done = told.filter("layer >= 0")
    if overlapping:
        done = done.withColumn("layer", F.explode(F.sequence(F.col("layer"), F.col("layers") - 1)))
    ends = told.filter("layer < 0").select(*rows.columns)
    ends = layerify(Index(ends, index.docs, index.compat_avgdl).scored(), s, overlapping=overlapping)
    pick = lambda df: df.select("term", "layer", "doc_id", "tf", "score")
    return pick(done).unionByName(pick(ends))
