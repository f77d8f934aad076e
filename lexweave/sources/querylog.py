"""Query logs and topics."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def to_ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, and what is not ASCII dropped; Spark has no built-in for it."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def read_queries(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows (qid, query) of lines ``qid:words`` or ``words`` (qid 0)."""
    line = F.col(column)
    number = F.regexp_extract(line, r"^\s*(\d+):", 1)
    return lines.select(F.when(number != "", number).otherwise("0").cast("bigint").alias("qid"), F.regexp_replace(line, r"^\s*\d+:", "").alias("query"))


def preprocess(lines: DataFrame, column: str = "value") -> DataFrame:
    """Raw log lines ``N:query`` as lines of letters, digits and blanks."""
    return lines.select(F.regexp_replace(F.regexp_replace(to_ascii(F.col(column)), r"^[0-9]+:", ""), "[^a-zA-Z0-9 ]", " ").alias(column))


def topics(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows (qid, query) of topic files: numbers and lower-case titles."""
    pattern = r"<num> Number: (?:NP)?(\d+)\s*\n\s*<title>\s*([^\n<]*)"
    numbers, titles = (F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(g)) for g in (1, 2))
    rows = texts.select(F.posexplode(numbers).alias("i", "n"), titles.alias("t")).select("n", F.col("t")[F.col("i")].alias("t"))
    return rows.select(F.col("n").cast("bigint").alias("qid"), F.trim(F.regexp_replace(F.lower("t"), r"\W+", " ")).alias("query"))


def _words(column: str):
    return F.size(F.filter(F.split(F.trim(F.col(column)), r"\s+"), lambda x: x != ""))


def of_length(queries: DataFrame, words: int, column: str = "query") -> DataFrame:
    """The queries of so many words."""
    return queries.filter(_words(column) == words)


def average_length(queries: DataFrame, column: str = "query") -> DataFrame:
    return queries.agg(F.count("*").alias("n_queries"), F.avg(_words(column)).alias("avg_words"))
