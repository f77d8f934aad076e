"""Ranks, gaps and running sums within lists of any length, without a task that holds a whole list.

A window over a term sorts all of its postings in one task, and the longest lists
grow with the corpus. Here the rows are cut into ranges of (term, order), so that a
long list spreads over many; each range is numbered as it streams by, and what a
list holds in the ranges before is added afterwards from a table of as many rows as
there are ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import cut, ship

#: Rows that a range holds on average, where their number is known.
RANGE = 2 << 20


def _starts(names: pa.Array, last: str | None) -> np.ndarray:
    """Where a row's name differs from the one before; last: the name before the first row."""
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    code = names.dictionary_encode()
    index = code.indices.to_numpy(zero_copy_only=False)
    return np.r_[last is None or code.dictionary[int(index[0])].as_py() != last, index[1:] != index[:-1]]


def _number(by: int, value: int | None) -> Callable:
    """Adds to sorted batches: place in the run of equal names, value of the row before, and sum of the values of the run so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, before, total = None, 0, 0, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = _starts(b.column(by), last)
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            at = np.arange(n) - (start[group] if len(start) and new[0] else np.where(group >= 0, start[np.maximum(group, 0)] if len(start) else 0, -held))
            columns = [pa.array(at.astype(np.int64))]
            if value is not None:
                v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
                lag = np.r_[before, v[:-1]]
                run_sum = np.cumsum(v)
                base = np.where(group >= 0, (run_sum - v)[start[np.maximum(group, 0)]] if len(start) else 0, -total)
                sums = run_sum - base
                columns += [pa.array(lag, mask=at == 0), pa.array(sums)]
                before, total = int(v[-1]), int(sums[-1])
            last, held = b.column(by)[n - 1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "__at", *(["__lag", "__sum"] if value is not None else [])])

    return run


def numbered(df: DataFrame, by: str, order: list[Column | str], rank: str | None = None, lag: tuple[str, str] | None = None, total: tuple[str, str] | None = None) -> DataFrame:
    """Adds within the rows of equal ``by``, in ``order``: ``rank`` from 0; ``lag`` (new column, column), the value of the row before, null for the first; ``total`` (new column, column), the sum up to the row.

    ``by`` must not be null; ``order`` should tell all rows of a list apart.
    """
    spark = df.sparkSession
    ship(spark)
    value = lag[1] if lag else total[1] if total else None
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(parts, by, *order).sortWithinPartitions(by, *order).withColumn("__part", F.spark_partition_id())
    names = rows.columns
    extra = ", __at bigint" + (", __lag bigint, __sum bigint" if value else "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + extra
    rows = cut(rows.mapInArrow(_number(names.index(by), names.index(value) if value else None), schema), "numbered")
    # two names for each range at most can go on in another one
    ends = rows.groupBy("__part").agg(F.array_distinct(F.array(F.min(by), F.max(by))).alias(by)).select(F.explode(by).alias(by)).distinct()
    held = rows.join(F.broadcast(ends), by, "left_semi").groupBy(by, "__part").agg(F.count("*").alias("__n"), *([F.max_by(value, "__at").alias("__last"), F.max_by("__sum", "__at").alias("__all")] if value else []))
    run = Window.partitionBy(by).orderBy("__part")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(by, "__part", F.sum("__n").over(before).alias("__skip"), *([F.lag("__last").over(run).alias("__prior"), F.sum("__all").over(before).alias("__base")] if value else [])).filter("__skip is not null")
    out = rows.join(F.broadcast(held), [by, "__part"], "left")
    if rank:
        out = out.withColumn(rank, F.col("__at") + F.coalesce("__skip", F.lit(0)))
    if lag:
        out = out.withColumn(lag[0], F.coalesce("__lag", "__prior"))
    if total:
        out = out.withColumn(total[0], F.col("__sum") + F.coalesce("__base", F.lit(0)))
    keep = [n for n in names if n != "__part"]
    return out.select(*keep, *([rank] if rank else []), *([lag[0]] if lag else []), *([total[0]] if total else []))


def _chunks(size: int) -> Callable:
    """Sorted batches (name, id) of a range as rows (name, chunk_no, v, prior, whole).

    Chunks of lists that begin here are whole, with gaps as ``v``. Ids of the range's
    first list, which may have begun before, and of its last unfinished chunk, which may
    go on, are told as they are; ``prior`` is the id before them where it is known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        held, chunk, prior = np.zeros(0, np.int64), 0, 0

        def rows(names: pa.Array, numbers: np.ndarray, values: np.ndarray, length: np.ndarray, before: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
            offsets = pa.array(np.r_[0, np.cumsum(length)].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(values))
            return pa.RecordBatch.from_arrays([names, pa.array(numbers.astype(np.int32)), lists, pa.array(before, mask=np.asarray(pc.equal(names, first).to_numpy(zero_copy_only=False), bool) | whole), pa.array(whole)], ["name", "chunk_no", "v", "prior", "whole"])

        for b in batches:
            if not b.num_rows:
                continue
            names = b.column(0)
            new = _starts(names, last)
            ids = np.r_[held, b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)]
            # the list that goes on has a start of its own, before its held ids
            goes_on = len(held) > 0 or not new[0]
            starts = np.r_[np.zeros(int(goes_on), np.int64), np.flatnonzero(new) + len(held)]
            if first is None:
                first = names[0].as_py()
            of = names.take(pa.array(np.flatnonzero(new)))
            group_name = pa.concat_arrays([pa.array([last] if goes_on else [], names.type), of])
            count = np.diff(np.append(starts, len(ids)))
            at = np.arange(len(ids)) - np.repeat(starts, count)
            lag = np.r_[0, ids[:-1]]
            lag[starts] = 0
            if goes_on:
                lag[0] = prior
            begin = np.flatnonzero(at % size == 0)
            length = np.diff(np.append(begin, len(ids)))
            group = np.searchsorted(starts, begin, "right") - 1
            number = at[begin] // size + np.where(goes_on & (group == 0), chunk, 0)
            open_ = int(length[-1]) < size  # the last chunk may grow
            n = len(begin) - open_
            held, chunk, prior = (ids[begin[-1] :], int(number[-1]), int(lag[begin[-1]])) if open_ else (ids[:0], int(number[-1]) + 1, int(ids[-1]))
            last = group_name[len(group_name) - 1].as_py()
            if n:
                told = group_name.take(pa.array(group[:n]))
                whole = ~np.asarray(pc.equal(told, first).to_numpy(zero_copy_only=False), bool)
                upto = int(begin[n]) if open_ else len(ids)
                values = np.where(np.repeat(whole, length[:n]), (ids - lag)[:upto], ids[:upto])
                yield rows(told, number[:n], values, length[:n], lag[begin[:n]], whole)
        if len(held):
            yield rows(pa.array([last]), np.array([chunk]), held, np.array([len(held)]), np.array([prior]), np.array([False]))

    return run


def chunked(df: DataFrame, by: str, value: str, size: int) -> DataFrame:
    """Rows (``by``, chunk_no, v) of a written table: the gaps of each ``size`` values of a list, in order.

    A range has whole chunks of all lists but those at its ends; these, few rows, are
    numbered afterwards.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(by, F.col(value).cast("bigint").alias(value))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // RANGE)
    ranges = rows.repartitionByRange(parts, by, value).sortWithinPartitions(by, value)
    told = cut(ranges.mapInArrow(_chunks(size), f"{by} string, chunk_no int, v array<bigint>, prior bigint, whole boolean"), "chunked")
    ends = told.filter("not whole")
    begun = ends.filter("prior is not null").select(by, F.col("chunk_no").alias("__chunk"), F.col("prior").alias("__prior"))
    left = numbered(ends.select(by, F.explode("v").alias(value)), by, [value], rank="__rank", lag=("__before", value)).join(F.broadcast(begun), by, "left")
    left = left.select(by, value, (F.col(value) - F.coalesce("__before", "__prior", F.lit(0))).alias("gap"), (F.coalesce("__chunk", F.lit(0)) + F.floor(F.col("__rank") / size)).cast("int").alias("chunk_no"))
    left = left.groupBy(by, "chunk_no").agg(F.array_sort(F.collect_list(F.struct(value, "gap"))).alias("v")).select(by, "chunk_no", F.col("v.gap").alias("v"))
    return told.filter("whole").select(by, "chunk_no", "v").unionByName(left)
