"""Ranked text search over a stored index, for a table of queries.

A row's score for a query is the sum of its fields' weights over the query's
distinct tokens that the field holds, divided by their number.  The index
posts each token with the rows that hold it and the weight they give it, and
keeps for each token how many rows hold it and the largest weight.

A search reads the lists of a query's rarest tokens first, and scores their
rows by the rows' own tokens: the k-th best is a score that the result reaches
at least.  Frequent tokens whose largest weights together stay below it cannot
bring in a row of their own, so that their lists are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import ensure_checkpoint_dir

SHARDS = 64
SLACK = 1e-4  # scores are compared to four digits

Fields = Sequence[tuple[str, float]]


def _shard(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def postings_of(rows: DataFrame, ident: str, fields: Fields) -> DataFrame:
    """(term, id, weight): the tokens of a row's fields, each with the summed weight of the fields that hold it."""
    held = F.struct(*(X.tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"f{i}") for i, (f, _) in enumerate(fields)))

    def posted(s: Column) -> Column:
        weight = lambda t: sum((F.when(F.array_contains(s[f"f{i}"], t), w).otherwise(0.0) for i, (_, w) in enumerate(fields)), F.lit(0.0))
        return F.transform(F.array_distinct(F.concat(*(s[f"f{i}"] for i in range(len(fields))))), lambda t: F.struct(t.alias("term"), weight(t).alias("weight")))

    return rows.select(F.col(ident).alias("id"), F.explode(F.transform(F.array(held), posted)[0]).alias("p")).select("p.term", "id", "p.weight")


def write_index(rows: DataFrame, path: str, ident: str, fields: Fields, shards: int = SHARDS) -> None:
    """Writes the postings, in folders by a hash of the term and sorted by term within, a row of figures for each term, and the tokens of each row.

    Rows are told by ``ident``.  Null fields hold nothing; a token that most
    rows hold is spread over several files.
    """
    posted = postings_of(rows, ident, fields).withColumn("shard", _shard(F.col("term"), shards))
    posted.repartitionByRange("shard", "term", "id").sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
    stored = rows.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("top"), F.first("shard").alias("shard")).write.mode("overwrite").parquet(f"{path}/terms")
    rows.select(F.col(ident).alias("id"), *(F.array_distinct(X.tokens(F.coalesce(F.col(f), F.lit("")))).alias(f"f{i}") for i, (f, _) in enumerate(fields))).write.mode("overwrite").parquet(f"{path}/rows")


class Lists(NamedTuple):
    """What a search reads: ``queries`` (qid, query, terms), ``lists`` (qid, m, term, df, top, shard, seed, least, essential), ``seeds`` (qid, id, score)."""

    queries: DataFrame
    lists: DataFrame
    seeds: DataFrame


def plan_lists(spark: SparkSession, path: str, queries: DataFrame, k: int, fields: Fields, column: str = "query") -> Lists:
    """The lists of each distinct query, and which of them have to be read.

    The rarest lists that hold ``k`` rows together are its seeds.  ``least``
    is the score of the k-th best of their rows, 0 if there are fewer.  A list
    is essential if it and all more frequent ones may add up to that.
    """
    ensure_checkpoint_dir(spark)
    distinct = queries.select(F.col(column).alias("query")).where(F.col(column).isNotNull()).distinct()
    asked = distinct.select(F.monotonically_increasing_id().alias("qid"), "query", F.array_distinct(X.tokens(F.col("query"))).alias("terms")).checkpoint()
    long = asked.select("qid", F.size("terms").alias("m"), F.explode("terms").alias("term")).join(spark.read.parquet(f"{path}/terms"), "term")
    rare, often = Window.partitionBy("qid").orderBy("df", "term"), Window.partitionBy("qid").orderBy(F.desc("df"), F.desc("term"))
    before = F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounded = long.withColumns({"seed": before < k, "bound": F.sum("top").over(often.rowsBetween(Window.unboundedPreceding, 0))}).checkpoint()
    seeds = bounded.where("seed")
    met = seeds.select("qid", "term").join(read_postings(spark, path, seeds), "term").select("qid", "id").distinct()
    scored = _scored(spark, path, met, asked, fields).checkpoint()
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    least = scored.select("qid", "score", place.alias("n")).where(F.col("n") <= k).where(F.col("n") == k).select("qid", F.col("score").alias("least"))
    lists = bounded.join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    return Lists(asked, lists.withColumn("essential", F.col("bound") / F.col("m") >= F.col("least") - SLACK).drop("bound"), scored)


def _scored(spark: SparkSession, path: str, pairs: DataFrame, queries: DataFrame, fields: Fields) -> DataFrame:
    """(qid, id, score) of pairs (qid, id), by the tokens of either."""
    joined = pairs.join(spark.read.parquet(f"{path}/rows"), "id").join(queries.select("qid", "terms"), "qid")
    total = sum((F.lit(w) * F.size(F.array_intersect("terms", f"f{i}")) for i, (_, w) in enumerate(fields)), F.lit(0.0))
    return joined.select("qid", "id", (total / F.size("terms")).alias("score"))


def read_postings(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """The stored postings, of the folders that ``terms`` (with a shard each) name."""
    shards = [r.shard for r in terms.select("shard").distinct().collect()]  # at most SHARDS
    return spark.read.parquet(f"{path}/postings").where(F.col("shard").isin(shards) if shards else F.lit(False)).drop("shard")


def search_all(rows: DataFrame, path: str, queries: DataFrame, k: int, ident: str, fields: Fields, order: Sequence[str] = (), column: str = "query") -> DataFrame:
    """(query, rank, id, score): the ``k`` best rows of each distinct query with a score above 0, to four digits.

    Ties go by the columns in ``order``, then by ``ident``.  ``rows`` are those
    that were indexed at ``path`` under the same fields.  Null queries and
    those without a token find nothing.
    """
    spark = rows.sparkSession
    asked, lists, seeds = plan_lists(spark, path, queries, k, fields, column)
    more = lists.where("essential and not seed").checkpoint()
    # rows outside the seeds' lists: what they may get at most is known before their text is looked at
    skipped = lists.where("not seed").groupBy("qid").agg(F.sum(F.when(~F.col("essential"), F.col("top")).otherwise(0.0)).alias("skipped"), F.first("least").alias("least"), F.first("m").alias("m"))
    found = more.select("qid", "term").join(read_postings(spark, path, more), "term").groupBy("qid", "id").agg(F.sum("weight").alias("s"))
    likely = found.join(skipped, "qid").where((F.col("s") + F.col("skipped")) / F.col("m") >= F.col("least") - SLACK).select("qid", "id").join(seeds.select("qid", "id"), ["qid", "id"], "left_anti")
    least = lists.select("qid", "least").distinct()
    best = seeds.unionByName(_scored(spark, path, likely, asked, fields)).join(least, "qid").where(F.col("score") >= F.col("least") - SLACK)
    named = rows.select(F.col(ident).alias("id"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), *(f"__o{i}" for i in range(len(order))), "id"))
    ranked = best.select("qid", "id", F.round("score", 4).alias("score")).join(named, "id").withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(asked.select("qid", "query"), "qid").select("query", "rank", "id", "score")
