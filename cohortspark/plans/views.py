"""The clinical notions over the driver's tables: orders stand for visits, customers for patients, line items for prescriptions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoints'."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def visits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("visit_id"), F.col("o_custkey").alias("case_no"), F.col("o_orderdate").cast("date").alias("visit_date"), F.col("o_orderpriority").alias("visit_reason"))


def patients(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("case_no"), F.col("c_mktsegment").alias("gender"), (F.col("c_custkey") % 90).cast("double").alias("age"))


def medicines(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("visit_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("p_partkey"), "l_returnflag", "l_linestatus", "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("molecule"), F.col("p_brand").alias("brand"), F.col("p_type").alias("form"), (F.col("p_size") % 2 == 0).alias("is_fdc"))
    return items.join(parts, "p_partkey")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Per visit with prescriptions: expected and predicted brands, in order of their names."""
    rows = medicines(spark, d)
    named = lambda flag: F.array_sort(F.collect_list(F.when(flag, F.lower("brand"))))
    per_visit = rows.groupBy("visit_id").agg(named(F.col("l_returnflag") != "R").alias("expected"), named(F.col("l_linestatus") == "O").alias("predicted"))
    return per_visit.join(visits(spark, d), "visit_id").join(patients(spark, d), "case_no")


VISITS_SQL = """visits AS (SELECT o_orderkey AS visit_id, o_custkey AS case_no, CAST(o_orderdate AS DATE) AS visit_date, o_orderpriority AS visit_reason FROM orders)"""
PATIENTS_SQL = """patients AS (SELECT c_custkey AS case_no, c_mktsegment AS gender, CAST(c_custkey % 90 AS DOUBLE) AS age FROM customer)"""
MEDICINES_SQL = """medicines AS (SELECT l_orderkey AS visit_id, l_linenumber AS pos, p_name AS molecule, p_brand AS brand, p_type AS form, p_size % 2 = 0 AS is_fdc, l_returnflag, l_linestatus, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey)"""
TOKENS_SQL = f"""{VISITS_SQL}, {PATIENTS_SQL}, {MEDICINES_SQL}, tokens AS (
  SELECT * FROM (SELECT visit_id, coalesce(list(lower(brand) ORDER BY lower(brand)) FILTER (l_returnflag <> 'R'), []) AS expected, coalesce(list(lower(brand) ORDER BY lower(brand)) FILTER (l_linestatus = 'O'), []) AS predicted FROM medicines GROUP BY visit_id)
  JOIN visits USING (visit_id) JOIN patients USING (case_no))"""
BAND_SQL = "CASE WHEN {a} <= 5 THEN 0 WHEN {a} <= 9 THEN 1 WHEN {a} <= 12 THEN 2 WHEN {a} <= 17 THEN 3 WHEN {a} <= 25 THEN 4 WHEN {a} <= 40 THEN 5 WHEN {a} <= 60 THEN 6 ELSE 7 END"


def band_sql(a: str) -> str:
    return BAND_SQL.format(a=a)


def age_sql(a: str, b: str) -> str:
    gap = f"abs(({band_sql(a)}) - ({band_sql(b)}))"
    return f"CASE WHEN {gap} >= 3 THEN 0.0 ELSE 0.7 * CASE {gap} WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.1 END + 0.3 * exp(-(ln(1 + {a}) - ln(1 + {b})) * (ln(1 + {a}) - ln(1 + {b})) / 0.18) END"
