"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree domain -> language -> source. At each node the
children share the node's budget in proportion to their weights, none above what
it holds (its tokens times ``max_epochs``); what a child can't take goes to its
siblings first, and only what a whole family can't take reaches the family's own
siblings. Each leaf then reads its documents in seeded epochs, each a fresh
pseudo-random order, and gives the first tokens of that stream up to its budget.

Weights are any finite numbers from 0 on, shares as well as multiples; a negative,
infinite or undefined one raises ValueError. A leaf with a weight of 0 on its path
gives nothing and holds nothing: its share goes to its siblings, and a family of
nothing but such leaves leaves its share to the family's own siblings. Where all
weights are 0 the result is empty.

Defined results: rows without id and texts without tokens are left out; a null
language or source is a leaf of its own, named ``unknown``; a very long text is
counted whole, and cut where its leaf's budget ends; repeated rows are documents
of their own; documents that tie in the shuffled order (repeated ids) follow each
other by length; an empty table gives an empty result; other columns are not read,
whatever their names. Budgets are whole tokens: rounding down leaves less than one
token per child unassigned.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import isfinite

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.session import cut, ship, small

#: Production parameters of the query: a share of all tokens, and weights by path.
FRACTION = 0.6
MAX_EPOCHS = 4
SEED = 17
DOMAINS = {"src0": "crawl", "src1": "crawl", "src2": "crawl", "src3": "crawl", "src4": "crawl", "src5": "news", "src6": "news", "src7": "news", "src8": "reference", "src9": "reference", "src10": "reference", "src11": "books", "src12": "books"}
OTHER = "forum"
WEIGHTS = {("crawl",): 30, ("news",): 25, ("reference",): 25, ("books",): 15, ("forum",): 5, ("crawl", "en"): 4, ("reference", "de"): 3, ("books", "fr"): 2, ("crawl", "en", "src0"): 2}
#: Hex digits of the shuffle key that name a bucket; only one bucket of a leaf is ever sorted.
BUCKET_DIGITS = 3
WORD = r"[^ \t\n\r]+"


def _named(values: Mapping[str, str], key: Column, other: str) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _weight(weights: Mapping[tuple, float], levels: list[str]) -> Column:
    out = F.lit(1.0)
    for path, w in weights.items():
        if len(path) == len(levels):
            hit = F.lit(True)
            for c, v in zip(levels, path):
                hit &= F.col(c) == v
            out = F.when(hit, float(w)).otherwise(out)
    return out


def _fill(nodes: DataFrame, parent: list[str], levels: list[str]) -> DataFrame:
    """Water-filling of ``given`` (the parent's budget) over its children: adds ``budget``.

    Children in order of capacity by weight: as long as they can't take their
    share the common level rises, so the level is the largest of the running ones.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), *levels)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("level", (F.col("given") - before) / rest)
    nodes = nodes.withColumn("level", F.max("level").over(Window.partitionBy(*parent)))
    share = F.floor(F.col("weight") * F.col("level") + F.lit(1e-6))
    return nodes.withColumn("budget", F.greatest(F.lit(0), F.least(F.col("cap"), share)).cast("bigint")).drop("level")


def leaf_budgets(leaves: DataFrame, weights: Mapping[tuple, float], fraction: float, max_epochs: int) -> DataFrame:
    """Budgets of the leaves (domain, lang, source, tokens): adds ``budget``. A tree of names, not of documents."""
    for path, w in weights.items():
        if not (isfinite(w) and w >= 0):
            raise ValueError(f"weight of {path} is {w}")
    leaves = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("bigint"))
    names = ["domain", "lang", "source"]
    given = leaves.agg(F.floor(F.sum("tokens") * fraction).cast("bigint").alias("given"))
    for depth in range(1, 4):
        leaves = leaves.filter(_weight(weights, names[:depth]) > 0)
    out = None
    for depth in range(1, 4):
        levels, parent = names[:depth], names[: depth - 1]
        nodes = leaves.groupBy(*levels).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(weights, levels))
        nodes = nodes.crossJoin(given) if out is None else nodes.join(out.select(*parent, F.col("budget").alias("given")), parent)
        out = _fill(nodes, parent, levels)
    return out.select(*names, "tokens", "budget")


def count_tokens(text: Column) -> Column:
    """Tokens: runs without blank, tab or line break."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix(docs: DataFrame, domains: Mapping[str, str] = DOMAINS, other: str = OTHER, weights: Mapping[tuple, float] = WEIGHTS, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, domain, lang, source, epoch, n_tokens, take_tokens): what each epoch takes of each document."""
    spark = docs.sparkSession
    ship(spark)
    name = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    slim = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", _named(domains, name("source"), other).alias("domain"), name("lang").alias("lang"), name("source").alias("source"), count_tokens(F.col("text")).alias("n_tokens"))
    slim = cut(slim.filter("n_tokens > 0"), "mixing-docs")
    leaf = ["domain", "lang", "source"]
    leaves = slim.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    plan = cut(leaf_budgets(leaves, weights, fraction, max_epochs).filter("budget > 0").select(*leaf, F.expr("budget div tokens").cast("int").alias("epoch"), F.expr("budget % tokens").alias("rest")).coalesce(1), "mixing-plan")
    n_leaves = plan.count()
    width = 200  # three names and a few numbers
    columns = ["doc_id", *leaf, "epoch", "n_tokens", "take_tokens"]
    whole = slim.join(small(plan, n_leaves, width), leaf).filter("epoch > 0").withColumn("epoch", F.explode(F.expr("sequence(0, epoch - 1)"))).withColumn("take_tokens", F.col("n_tokens")).select(columns)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("doc_id").cast("string")))
    keyed = lambda rows: rows.withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    some = plan.filter("rest > 0")
    # the bucket in which each leaf's budget ends: what is before it is taken whole, what is after it not at all
    bucket = keyed(slim.join(small(some, n_leaves, width), leaf)).groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("held"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket = bucket.withColumn("before", F.coalesce(F.sum("held").over(run), F.lit(0))).filter("before < rest and before + held >= rest")
    ends = cut(some.join(bucket.select(*leaf, F.col("bucket").alias("last"), "before"), leaf).coalesce(1), "mixing-ends")
    part = keyed(slim.join(small(ends, n_leaves, width), leaf)).filter("bucket <= last")
    inside = part.filter("bucket < last").withColumn("take_tokens", F.col("n_tokens")).select(columns)
    order = Window.partitionBy(*leaf).orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = part.filter("bucket = last").withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    edge = edge.filter("at < rest").withColumn("take_tokens", F.expr("least(n_tokens, rest - at)")).select(columns)
    return whole.unionByName(inside).unionByName(edge)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over the whole documents table."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(domains: Mapping[str, str] = DOMAINS, other: str = OTHER, weights: Mapping[tuple, float] = WEIGHTS, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """DuckDB SQL of ``mix`` over the documents table."""
    domain = "CASE " + " ".join(f"WHEN source = '{k}' THEN '{v}'" for k, v in domains.items()) + f" ELSE '{other}' END"

    def weight(levels: list[str]) -> str:
        cases = [f"WHEN {' AND '.join(f'{c} = {v!r}' for c, v in zip(levels, path))} THEN {float(w)!r}::DOUBLE" for path, w in reversed(weights.items()) if len(path) == len(levels)]
        return "CASE " + " ".join(cases) + " ELSE 1.0::DOUBLE END" if cases else "1.0::DOUBLE"

    positive = " AND ".join(f"{weight(['domain', 'lang', 'source'][:n])} > 0" for n in (1, 2, 3))

    def level(n: int) -> str:
        names = ["domain", "lang", "source"]
        levels, parent = names[:n], names[: n - 1]
        by = f"PARTITION BY {', '.join(parent)}" if parent else ""
        given = "(SELECT CAST(floor(sum(tokens) * CAST(%s AS DOUBLE)) AS BIGINT) FROM leaves)" % fraction if n == 1 else "p.budget"
        join = "" if n == 1 else f" JOIN l{n - 1} p USING ({', '.join(parent)})"
        cols = ", ".join(levels)
        return f"""n{n} AS (SELECT {cols}, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {max_epochs} AS BIGINT) AS cap, {weight(levels)} AS weight FROM open_leaves GROUP BY {cols}),
g{n} AS (SELECT {', '.join(f'n{n}.{c}' if n == 1 else c for c in levels)}, n{n}.tokens, n{n}.cap, n{n}.weight, {given} AS given FROM n{n}{join}),
v{n} AS (SELECT *, CAST(given - coalesce(sum(cap) OVER ({by} ORDER BY cap / weight, {cols} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(weight) OVER ({by} ORDER BY cap / weight, {cols} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM g{n}),
l{n} AS (SELECT {cols}, tokens, CAST(greatest(0, least(cap, floor(weight * max(lev) OVER ({by}) + 1e-6))) AS BIGINT) AS budget FROM v{n})"""

    return f"""WITH d AS (SELECT doc_id, {domain} AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS BIGINT) AS n_tokens FROM documents WHERE doc_id IS NOT NULL),
slim AS (SELECT * FROM d WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM slim GROUP BY ALL),
open_leaves AS (SELECT * FROM leaves WHERE {positive}),
{level(1)},
{level(2)},
{level(3)},
plan AS (SELECT domain, lang, source, CAST(budget // tokens AS INTEGER) AS epoch, budget % tokens AS rest FROM l3 WHERE budget > 0),
whole AS (SELECT doc_id, domain, lang, source, CAST(e.i AS INTEGER) AS epoch, n_tokens, n_tokens AS take_tokens FROM slim JOIN plan USING (domain, lang, source) JOIN range({max_epochs}) e(i) ON e.i < plan.epoch),
part AS (SELECT doc_id, domain, lang, source, plan.epoch, n_tokens, rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '{seed}', CAST(plan.epoch AS VARCHAR), CAST(doc_id AS VARCHAR))), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM slim JOIN plan USING (domain, lang, source) WHERE rest > 0)
SELECT * FROM whole UNION ALL SELECT doc_id, domain, lang, source, epoch, n_tokens, CAST(least(n_tokens, rest - before) AS BIGINT) AS take_tokens FROM part WHERE before < rest"""


SQL = sql()
