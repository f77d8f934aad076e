"""Layers of asked lists, told by document.

A layer starts at a rank of (falling score, document), so that the score and the
document there bound it: no posting needs its own rank. Only the distinct scores of a
list are counted, and of the runs of equal scores that a boundary cuts the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.bm25 import DIGITS
from lexweave.operators.asked import Asked, flat, score
from lexweave.operators.layers import Strategy, starts, strategy
from lexweave.session import cut, ship

_ALL = np.int64(np.iinfo(np.int64).min)


@dataclass(frozen=True, eq=False)
class Layered(Asked):
    """forward has ``layers``, too; n and max_score by term number and layer."""

    n: np.ndarray = None
    max_score: np.ndarray = None
    layering: str = ""


def _points(b: pa.RecordBatch, idf: np.ndarray, avgdl: float):
    length, row, no, tf = flat(b)
    return row, no, np.floor(score(tf, length[row], idf[no], avgdl) * 10**DIGITS + 0.5).astype(np.int64)


def _runs(idf: np.ndarray, avgdl: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, no, points = _points(b, idf, avgdl)
            key, n = np.unique((no.astype(np.int64) << 32) | points, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array(key & 0xFFFFFFFF), pa.array(n)], ["no", "points", "n"])

    return run


def _bounds(s: Strategy):
    def run(table: pa.Table) -> pa.Table:
        points, n = (table.column(c).to_numpy() for c in ("points", "n"))
        order = np.argsort(-points)
        points, n = points[order], n[order]
        at = np.array(starts(n, s)[1:], np.int64)
        ends = np.cumsum(n)
        r = np.searchsorted(ends, at, "right")
        no = table.column("no")[0].as_py()
        return pa.table({"no": pa.array([no] * len(at), pa.int32()), "layer": pa.array(np.arange(1, len(at) + 1).astype(np.int32)), "points": points[r], "skip": at - (ends - n)[r]})

    return run


def layered(index: Asked, name: str) -> Layered:
    """The same lists with the layers of a strategy by shares."""
    s = strategy(name)
    if not s.shares:
        raise ValueError(f"{name} has no shares")
    spark = index.forward.sparkSession
    ship(spark)
    idf, avgdl, names = index.idf, index.avgdl, len(index.names)
    runs = index.forward.mapInArrow(_runs(idf, avgdl), "no int, points bigint, n bigint").groupBy("no", "points").agg(F.sum("n").alias("n"))
    told = runs.groupBy("no").applyInArrow(_bounds(s), "no int, layer int, points bigint, skip bigint").collect()
    points = np.full((s.layers, names), -1, np.int64)
    doc = np.full((s.layers, names), _ALL)
    for r in told:
        points[r["layer"], r["no"]] = r["points"]
    split = [(r["no"], r["layer"], r["points"], r["skip"] + 1) for r in told if r["skip"]]

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array(sorted({(a << 32) | c for a, _, c, _ in split}), np.int64)
        for b in batches:
            row, no, at = _points(b, idf, avgdl)
            key = (no.astype(np.int64) << 32) | at
            hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            yield pa.RecordBatch.from_arrays([pa.array(no[hit].astype(np.int32)), pa.array(at[hit]), b.column(0).take(pa.array(row[hit])).cast(pa.int64())], ["no", "points", "doc_id"])

    if split:
        rank = F.row_number().over(Window.partitionBy("no", "points").orderBy("doc_id"))
        at = spark.createDataFrame(split, "no int, layer int, points bigint, rank bigint")
        ranked = index.forward.mapInArrow(tied, "no int, points bigint, doc_id bigint").withColumn("rank", rank.cast("bigint"))
        for r in ranked.join(F.broadcast(at), ["no", "points", "rank"]).select("no", "layer", "doc_id").collect():
            doc[r["layer"], r["no"]] = r["doc_id"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, at = _points(b, idf, avgdl)
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[row]
            layer = np.zeros(len(no), np.int32)
            for i in range(1, s.layers):
                layer += (at < points[i, no]) | ((at == points[i, no]) & (ids >= doc[i, no]))
            nos = b.column(2)
            offsets = pa.array(np.r_[0, np.cumsum(nos.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(layer))], [*b.schema.names, "layers"])

    kind = index.forward.schema["doc_id"].dataType.simpleString()
    forward = cut(index.forward.mapInArrow(assign, f"doc_id {kind}, doc_len bigint, nos array<int>, tfs array<int>, layers array<int>"), "asked-layers")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most = np.zeros(s.layers * names, np.int64), np.zeros(s.layers * names)
        for b in batches:
            length, row, no, tf = flat(b)
            key = b.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64) * names + no
            n += np.bincount(key, minlength=len(n))
            np.maximum.at(most, key, score(tf, length[row], idf[no], avgdl))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(most[some])], ["key", "n", "most"])

    n, most = np.zeros(s.layers * names, np.int64), np.zeros(s.layers * names)
    for r in forward.mapInArrow(parts, "key bigint, n bigint, most double").groupBy("key").agg(F.sum("n").alias("n"), F.max("most").alias("most")).collect():
        n[r["key"]], most[r["key"]] = r["n"], r["most"]
    given = {f.name: getattr(index, f.name) for f in fields(Asked)}
    return Layered(**given | {"forward": forward}, n=n.reshape(s.layers, names), max_score=most.reshape(s.layers, names), layering=name)
