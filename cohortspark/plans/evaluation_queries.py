"""Queries over expected and predicted treatments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import text as X
from ..operators import evaluation as A
from . import views as W

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_EVAL = f"""WITH {W.TOKENS_SQL}, e AS (
  SELECT *, len(expected) AS expected_count, len(predicted) AS prescribed_count, len(list_filter(expected, lambda x: list_contains(predicted, x))) AS matched_count FROM tokens
), c AS (SELECT *, CASE WHEN expected_count > 0 THEN matched_count * 100.0 / expected_count WHEN prescribed_count = 0 THEN 100.0 ELSE 0.0 END AS accuracy,
  CASE WHEN age <= 5 THEN '0-5' WHEN age <= 12 THEN '6-12' WHEN age <= 21 THEN '12-21' WHEN age <= 45 THEN '22-45' WHEN age <= 65 THEN '46-65' ELSE '65+' END AS age_group,
  visit_reason AS consultation_type, CASE WHEN expected_count > 5 THEN '5+' ELSE CAST(expected_count AS VARCHAR) END AS count_bucket,
  CASE WHEN prescribed_count > 5 THEN '5+' ELSE CAST(prescribed_count AS VARCHAR) END AS prescribed_bucket FROM e)
"""


def _evaluated(spark, d):
    rows = W.tokens(spark, d)
    out = rows.select("visit_id", "case_no", "age", "gender", "visit_reason", "expected", "predicted", *(c.alias(n) for n, c in A.case_evaluation(F.col("expected"), F.col("predicted")).items()))
    return out.withColumns({"age_group": I.age_group(F.col("age")), "consultation_type": F.col("visit_reason"), "count_bucket": I.count_bucket(F.col("expected_count")), "prescribed_bucket": I.count_bucket(F.col("prescribed_count"))})


@query(_EVAL + "SELECT visit_id, expected_count, prescribed_count, matched_count, round(accuracy, 4) AS accuracy, len(list_filter(predicted, lambda x: NOT list_contains(expected, x))) AS n_extra FROM c")
def j14_expected_vs_predicted(spark, d):
    n = lambda c: F.col(c).cast("long").alias(c)
    return _evaluated(spark, d).select("visit_id", n("expected_count"), n("prescribed_count"), n("matched_count"), F.round("accuracy", 4).alias("accuracy"), F.size("extra_prescribed").cast("long").alias("n_extra"))


@query(_EVAL + """SELECT CASE WHEN grouping(age_group) = 0 THEN 'age_group' WHEN grouping(gender) = 0 THEN 'gender' WHEN grouping(consultation_type) = 0 THEN 'consultation_type' WHEN grouping(count_bucket) = 0 THEN 'count_bucket' ELSE 'overall' END AS dimension,
  coalesce(age_group, gender, consultation_type, count_bucket, 'all') AS cohort, count(*) AS cases, CAST(sum(expected_count) AS BIGINT) AS expected, CAST(sum(prescribed_count) AS BIGINT) AS prescribed, CAST(sum(matched_count) AS BIGINT) AS matched,
  round(CASE WHEN sum(expected_count) > 0 THEN sum(matched_count) / sum(expected_count) * 100.0 ELSE 0.0 END, 4) AS accuracy, round(avg(accuracy), 4) AS mean_case_accuracy, round(CASE WHEN sum(prescribed_count) > 0 THEN sum(matched_count) / sum(prescribed_count) * 100.0 ELSE 0.0 END, 4) AS precision
FROM c GROUP BY GROUPING SETS ((age_group), (gender), (consultation_type), (count_bucket), ())""")
def a8_grouping_sets_accuracy(spark, d):
    return A.cohort_summary(_evaluated(spark, d))


@query(_EVAL + """, s AS (SELECT list_distinct(expected) AS e, list_distinct(predicted) AS p FROM c), k AS (SELECT count(DISTINCT t) AS catalogue FROM (SELECT unnest(list_distinct(list_concat(e, p))) AS t FROM s)),
m AS (SELECT CAST(sum(len(list_intersect(e, p))) AS BIGINT) AS tp, CAST(sum(len(list_filter(p, lambda x: NOT list_contains(e, x)))) AS BIGINT) AS fp, CAST(sum(len(list_filter(e, lambda x: NOT list_contains(p, x)))) AS BIGINT) AS fn, CAST(sum(greatest(0, catalogue - len(list_distinct(list_concat(e, p))))) AS BIGINT) AS tn FROM s, k)
SELECT tp, fp, fn, tn, round(tp / (tp + fp) * 100, 2) AS precision, round(tp / (tp + fn) * 100, 2) AS recall, round(tn / (tn + fp) * 100, 2) AS specificity, round(2 * tp / (2 * tp + fp + fn) * 100, 2) AS f1 FROM m""")
def a9_confusion(spark, d):
    return A.confusion(_evaluated(spark, d))


@query(_EVAL + """SELECT count_bucket AS expected_bucket, """ + ", ".join(f"count(*) FILTER (prescribed_bucket = '{b}') AS \"{b}\"" for b in ("0", "1", "2", "3", "4", "5", "5+")) + " FROM c GROUP BY 1")
def a10_count_crosstab(spark, d):
    return A.count_agreement(_evaluated(spark, d).withColumnRenamed("count_bucket", "expected_bucket"))


_OVR = _EVAL + """, x AS (SELECT visit_id, unnest(list_distinct(expected)) AS item, 1 AS e, 0 AS p FROM c UNION ALL SELECT visit_id, unnest(list_distinct(predicted)), 0, 1 FROM c), y AS (SELECT visit_id, item, max(e) AS e, max(p) AS p FROM x GROUP BY ALL),
i AS (SELECT item, CAST(sum(e * p) AS BIGINT) AS tp, CAST(sum((1 - e) * p) AS BIGINT) AS fp, CAST(sum(e * (1 - p)) AS BIGINT) AS fn FROM y GROUP BY 1), j AS (SELECT i.*, (SELECT count(*) FROM c) - tp - fp - fn AS tn, tp + fn AS support FROM i),
r AS (SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) * 100 ELSE 0 END, 2) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) * 100 ELSE 0 END, 2) AS recall, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) * 100 ELSE 0 END, 2) AS specificity, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) * 100 ELSE 0 END, 2) AS f1 FROM j)
"""


@query(_OVR + "SELECT * FROM r")
def a11_ovr(spark, d):
    return A.one_vs_rest(_evaluated(spark, d), "visit_id")


@query(_OVR + "SELECT round(avg(precision), 2) AS precision, round(avg(recall), 2) AS recall, round(avg(f1), 2) AS f1, count(*) AS items FROM r WHERE support > 0")
def a12_macro_average(spark, d):
    return A.macro_average(A.one_vs_rest(_evaluated(spark, d), "visit_id"))


_COMPARE = """, s AS (SELECT list_distinct(expected) AS e, list_distinct(predicted) AS p, list_distinct(list_filter(predicted, lambda x: x > 'brand#14')) AS q FROM c),
j AS (SELECT len(e) AS expected_n, len(q) AS old_n, len(p) AS new_n, len(list_filter(q, lambda x: NOT list_contains(e, x))) AS old_extra, len(list_filter(p, lambda x: NOT list_contains(e, x))) AS new_extra,
CASE WHEN len(e) > 0 THEN len(list_intersect(e, q)) / len(e) WHEN len(q) = 0 THEN 1.0 ELSE 0.0 END AS recall_old, CASE WHEN len(e) > 0 THEN len(list_intersect(e, p)) / len(e) WHEN len(p) = 0 THEN 1.0 ELSE 0.0 END AS recall_new FROM s)
"""


@query(_EVAL + _COMPARE + """SELECT count(*) AS cases, round(avg(recall_old), 4) AS recall_old, round(avg(recall_new), 4) AS recall_new, round(avg(recall_new - recall_old), 4) AS recall_change, round(avg(abs(old_n - expected_n)), 4) AS size_error_old, round(avg(abs(new_n - expected_n)), 4) AS size_error_new,
round(avg(old_extra), 4) AS extra_old, round(avg(new_extra), 4) AS extra_new, count(*) FILTER (recall_new > recall_old) AS improved, count(*) FILTER (recall_new < recall_old) AS regressed, count(*) FILTER (recall_new = recall_old) AS unchanged FROM j""")
def a13_run_comparison(spark, d):
    rows = _evaluated(spark, d).select(F.array_distinct("expected").alias("e"), F.array_distinct("predicted").alias("p"), F.array_distinct(F.filter("predicted", lambda x: x > "brand#14")).alias("q"))
    joined = rows.select(
        F.size("e").alias("expected_n"), F.size("q").alias("old_n"), F.size("p").alias("new_n"), F.size(F.array_except("q", "e")).alias("old_extra"), F.size(F.array_except("p", "e")).alias("new_extra"),
        A.set_recall(F.col("e"), F.col("q")).alias("recall_old"), A.set_recall(F.col("e"), F.col("p")).alias("recall_new"),
    )
    return A.run_comparison(joined)


@query(_EVAL + """SELECT item, count(*) AS missed FROM (SELECT unnest(list_filter(expected, lambda x: NOT list_contains(predicted, x))) AS item FROM c) GROUP BY 1 ORDER BY missed DESC, item LIMIT 15""")
def w12_top_missed(spark, d):
    rows = _evaluated(spark, d).select(F.explode("unmatched_expected").alias("item"))
    return rows.groupBy("item").agg(F.count("*").alias("missed")).orderBy(F.desc("missed"), "item").limit(15)


@query("""SELECT p_partkey, array_to_string(CASE WHEN p_partkey % 3 = 0 THEN [lower(p_name), lower(p_type)] WHEN p_partkey % 3 = 1 THEN [lower(p_brand), lower(p_name)] ELSE [lower(p_name)] END, '|') AS tokens FROM part""")
def t20_split_combo(spark, d):
    p = W.table(spark, d, "part")
    kind = F.col("p_partkey") % 3
    strengths = F.when(kind == 0, F.create_map(F.initcap("p_name"), F.lit(5.0), F.col("p_type"), F.lit(1.0))).when(kind == 2, F.create_map(F.upper("p_name"), F.lit(2.0)))
    molecule = F.when(kind == 1, F.concat(F.col("p_brand"), F.lit(" + "), F.col("p_name"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", F.array_join(X.component_tokens(F.col("p_brand"), molecule, strengths, "fdc_broken"), "|").alias("tokens"))


def _runs(spark, d):
    """Two runs over the same cases: what was expected and what each predicted, as medicines with dosage groups; some cases have no answer."""
    rows = W.medicines(spark, d)
    medicine = F.struct(F.col("molecule").alias("canonical_molecule"), F.col("form").alias("dosage_group_id"))
    listed = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("pos", medicine.alias("m"))))), lambda x: x["m"])
    base = rows.groupBy(F.col("visit_id").alias("case_no")).agg(listed(F.col("l_returnflag") != "R").alias("expected"), listed(F.col("l_linestatus") == "O").alias("new"), listed((F.col("l_linestatus") == "O") & (F.col("pos") > 1)).alias("old"))
    base = base.join(W.visits(spark, d).select(F.col("visit_id").alias("case_no"), F.col("visit_reason").alias("visit_type")), "case_no").withColumn("past_count", F.col("case_no") % 3)
    old = base.select("case_no", "expected", F.when(F.col("case_no") % 10 != 0, F.col("old")).alias("medications"), "visit_type", "past_count")
    new = base.where("case_no % 7 <> 0").select("case_no", F.col("new").alias("medications"))
    return A.compare_runs(old, new)


_RUNS = f"""WITH {W.VISITS_SQL}, {W.MEDICINES_SQL}, b AS (SELECT visit_id AS case_no, coalesce(list(lower(molecule)) FILTER (l_returnflag <> 'R'), []) AS e, coalesce(list(lower(molecule)) FILTER (l_linestatus = 'O'), []) AS n, coalesce(list(lower(molecule)) FILTER (l_linestatus = 'O' AND pos > 1), []) AS o,
coalesce(list(form) FILTER (l_returnflag <> 'R'), []) AS eg, coalesce(list(form) FILTER (l_linestatus = 'O'), []) AS ng, coalesce(list(form) FILTER (l_linestatus = 'O' AND pos > 1), []) AS og FROM medicines GROUP BY 1),
u AS (SELECT case_no, len(e) AS expected_n, len(o) AS old_n, len(n) AS new_n, list_distinct(e) AS e, list_distinct(n) AS n, list_distinct(o) AS o, list_distinct(eg) AS eg, list_distinct(ng) AS ng, list_distinct(og) AS og FROM b WHERE case_no % 7 <> 0 AND case_no % 10 <> 0),
r AS (SELECT u.*, visit_reason AS visit_type, u.case_no % 3 AS past_count, """ + ", ".join(f"CASE WHEN len({e}) > 0 THEN len(list_intersect({e}, {p})) / len({e}) WHEN len({p}) = 0 THEN 1.0 ELSE 0.0 END AS {name}" for e, p, name in (("e", "o", "recall_old"), ("e", "n", "recall_new"), ("eg", "og", "group_recall_old"), ("eg", "ng", "group_recall_new"))) + """,
list_sort(list_filter(e, lambda x: NOT list_contains(n, x))) AS missed, list_sort(list_filter(n, lambda x: NOT list_contains(e, x))) AS extra, list_sort(list_intersect(e, n)) AS matched, len(list_filter(o, lambda x: NOT list_contains(e, x))) AS old_extra FROM u JOIN visits ON u.case_no = visit_id)
"""


@query(_RUNS + "SELECT case_no, round(recall_old, 4) AS recall_old, round(recall_new, 4) AS recall_new, expected_n, old_n, new_n, array_to_string(matched, '|') AS matched, array_to_string(missed, '|') AS missed, array_to_string(extra, '|') AS extra FROM r")
def j12_run_join(spark, d):
    """An old run joined with a new one, case by case."""
    n = lambda c: F.col(c).cast("long").alias(c)
    return _runs(spark, d).select("case_no", F.round("recall_old", 4).alias("recall_old"), F.round("recall_new", 4).alias("recall_new"), n("expected_n"), n("old_n"), n("new_n"), *(F.array_join(c, "|").alias(c) for c in ("matched", "missed", "extra")))


@query(_RUNS + """SELECT count(*) AS cases, round(avg(recall_old), 4) AS recall_old, round(avg(recall_new), 4) AS recall_new, round(avg(recall_new - recall_old), 4) AS recall_change, round(avg(abs(old_n - expected_n)), 4) AS size_error_old, round(avg(abs(new_n - expected_n)), 4) AS size_error_new, round(avg(old_extra), 4) AS extra_old, round(avg(len(extra)), 4) AS extra_new,
count(*) FILTER (recall_new > recall_old) AS improved, count(*) FILTER (recall_new < recall_old) AS regressed, count(*) FILTER (recall_new = recall_old) AS unchanged, round(avg(group_recall_old), 4) AS group_recall_old, round(avg(group_recall_new), 4) AS group_recall_new FROM r""")
def h6_run_summary(spark, d):
    """The summary of two runs, dosage groups included."""
    return A.run_summary(_runs(spark, d))


@query(_RUNS + "SELECT visit_type AS cohort, count(*) AS cases, round(avg(recall_old) * 100, 1) AS recall_old, round(avg(recall_new) * 100, 1) AS recall_new FROM r GROUP BY 1")
def a14_recall_by_visit_type(spark, d):
    return A.recall_by(_runs(spark, d), F.col("visit_type"))


@query(_RUNS + "SELECT CASE WHEN past_count > 0 THEN 'with past cases' ELSE 'without past cases' END AS cohort, count(*) AS cases, round(avg(recall_old) * 100, 1) AS recall_old, round(avg(recall_new) * 100, 1) AS recall_new FROM r GROUP BY 1")
def a14_recall_by_history(spark, d):
    return A.by_history(_runs(spark, d))


@query(_RUNS + "SELECT molecule, count(*) AS cases FROM (SELECT unnest(extra) AS molecule FROM r) GROUP BY 1 ORDER BY cases DESC, molecule LIMIT 15")
def w12_top_extra(spark, d):
    return A.most_common(_runs(spark, d), "extra")


@query(_RUNS + "SELECT case_no, expected_n, new_n, new_n - expected_n AS difference FROM r WHERE abs(new_n - expected_n) >= 3")
def w12_size_mismatches(spark, d):
    n = lambda c: F.col(c).cast("long").alias(c)
    return A.size_mismatches(_runs(spark, d)).select("case_no", n("expected_n"), n("new_n"), n("difference"))


@query(_RUNS + "SELECT case_no, round(recall_new - recall_old, 4) AS change, array_to_string(missed, '|') AS missed FROM r WHERE recall_new > recall_old ORDER BY change DESC, case_no LIMIT 10")
def w12_most_improved(spark, d):
    return A.most_improved(_runs(spark, d)).select("case_no", "change", F.array_join("missed", "|").alias("missed"))


@query(_RUNS + "SELECT case_no, expected_n, new_n, array_to_string(missed, '|') AS missed FROM r WHERE recall_new = 0 AND expected_n > 0")
def w12_zero_scores(spark, d):
    n = lambda c: F.col(c).cast("long").alias(c)
    return A.zero_scores(_runs(spark, d)).select("case_no", n("expected_n"), n("new_n"), F.array_join("missed", "|").alias("missed"))


@query(_OVR + "SELECT item, support, f1 FROM r ORDER BY support DESC, item LIMIT 10")
def w13_ovr_top(spark, d):
    return A.top_items(A.one_vs_rest(_evaluated(spark, d), "visit_id"), 10).select("item", "support", "f1")


@query(_EVAL + """, s AS (SELECT gender AS cohort, count(*) AS cases, CAST(sum(matched_count) AS BIGINT) AS matched FROM c GROUP BY 1) SELECT 'gender' AS dimension, x AS cohort, coalesce(cases, 0) AS cases, coalesce(matched, 0) AS matched FROM (SELECT unnest(['BUILDING', 'NOBODY', 'MACHINERY']) AS x) LEFT JOIN s ON x = cohort""")
def a7_zero_filled_cohorts(spark, d):
    """Cohorts that are asked for, those without a case with zeros."""
    wanted = spark.createDataFrame([("gender", x) for x in ("BUILDING", "NOBODY", "MACHINERY")], "dimension string, cohort string")
    return A.filled_cohorts(A.cohort_summary(_evaluated(spark, d)), wanted).select("dimension", "cohort", "cases", "matched")
