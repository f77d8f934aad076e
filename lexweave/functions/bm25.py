"""BM25 with k1 = 2 and b = 0.75, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 2.0
B = 0.75
DIGITS = 6


def idf(df: Column, n: Column) -> Column:
    return F.log10(1 + (n - df + 0.5) / (df + 0.5))


def partial(tf: Column, doc_len: Column, idf_value: Column, avgdl: Column) -> Column:
    """Score that one term gives a document."""
    return idf_value * tf * (K1 + 1) / (tf + K1 * (1 - B) + K1 * B / avgdl * doc_len)
