"""Growing an index from a stream (an addition; the batch operators don't need it).

Each micro-batch is indexed on its own and appended as a run, which can be queried
at once; ``compact`` merges the runs. A batch that is replayed after a failure
replaces its own run, so each document is indexed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexweave.operators import index as ix


def append_runs(stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id", body: str = "text", fmt: str = "text", available_now: bool = True) -> StreamingQuery:
    """Start a query that writes each micro-batch of documents as a run below ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        i = ix.build(batch, key, body, fmt)
        for name, table in (("postings", i.postings), ("docs", i.docs)):
            table.write.mode("overwrite").parquet(f"{path}/{name}/run={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def load_runs(spark: SparkSession, path: str) -> ix.Index:
    """All runs as one index."""
    return ix.Index(spark.read.parquet(f"{path}/postings").drop("run"), spark.read.parquet(f"{path}/docs").drop("run"))


def compact(spark: SparkSession, path: str, out: str) -> None:
    """Merge the runs into a stored index in term order."""
    load_runs(spark, path).save(out)
