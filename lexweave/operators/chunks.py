"""Chunks of 128 postings, blocks of chunks, score bounds, and seeks in lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators.index import CHUNK
from lexweave.operators.ranks import numbered

#: Chunks in a block.
BLOCK = 8


def with_chunks(scored: DataFrame, size: int = CHUNK) -> DataFrame:
    """Adds chunk_no (from 0, in document order) to postings of lists."""
    return numbered(scored, "term", ["doc_id"], rank="__rank").withColumn("chunk_no", F.floor(F.col("__rank") / size).cast("int")).drop("__rank")


def chunk_stats(scored: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows (term, chunk_no, n, first_doc, last_doc, max_score)."""
    return stats_of(with_chunks(scored.select("term", "doc_id", "score"), size))


def stats_of(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy("term", "chunk_no").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.max("score").alias("max_score"))


def block_stats(chunks: DataFrame, size: int = BLOCK) -> DataFrame:
    """The same for runs of chunks: a block's bound is the largest of its chunks'."""
    return chunks.groupBy("term", F.floor(F.col("chunk_no") / size).cast("int").alias("block_no")).agg(F.sum("n").alias("n"), F.count("*").alias("n_chunks"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.max("max_score").alias("max_score"))


def list_max_scores(scored: DataFrame) -> DataFrame:
    return scored.groupBy("term").agg(F.count("*").alias("df"), F.max("score").alias("max_score"))


def next_geq(postings: DataFrame, seeks: DataFrame) -> DataFrame:
    """Rows (term, target, doc_id): the first document of the list at or after each target, null past its end."""
    hit = postings.select("term", "doc_id").join(seeks, "term").filter("doc_id >= target").groupBy("term", "target").agg(F.min("doc_id").alias("doc_id"))
    return seeks.distinct().join(hit, ["term", "target"], "left")


def next_greater_chunk(stats: DataFrame, seeks: DataFrame) -> DataFrame:
    """Rows (term, target, bound, doc_id): first document of the first chunk that starts after the target and may hold a score above the bound.

    The same serves blocks, whose rows have the same columns.
    """
    hit = stats.select("term", "first_doc", "max_score").join(seeks, "term").filter("first_doc > target and max_score > bound").groupBy("term", "target", "bound").agg(F.min("first_doc").alias("doc_id"))
    return seeks.distinct().join(hit, ["term", "target", "bound"], "left")


def score_bounds(stats: DataFrame, seeks: DataFrame) -> DataFrame:
    """Rows (term, target, max_score): bound of the chunk (or block) that covers each target."""
    return stats.join(seeks, "term").filter("target between first_doc and last_doc").select("term", "target", "max_score")
