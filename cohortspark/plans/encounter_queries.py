"""Queries over sources, joins, aggregates, windows and writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import vectors as V
from ..operators import encounters as E
from ..operators import similarity as S
from ..operators import upsert as U
from ..sources.readers import first_rows
from . import views as W

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def src_scan_limit(spark, d):
    return first_rows(W.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 100)


@query("SELECT count(*) AS n FROM orders")
def src_count(spark, d):
    return W.table(spark, d, "orders").agg(F.count("*").alias("n"))


@query(f"""WITH {W.VISITS_SQL}, {W.MEDICINES_SQL}, c AS (SELECT visit_id, count(*) FILTER (l_linestatus = 'O') AS n_meds, count(*) FILTER (l_returnflag <> 'N') AS n_dx FROM medicines GROUP BY 1)
SELECT visit_id, case_no, visit_date, n_meds, n_dx FROM visits JOIN c USING (visit_id) WHERE n_meds > 0 AND n_dx > 0 AND case_no <> 7 AND contains(lower(visit_reason), 'urgent')""")
def p3_candidate_filter(spark, d):
    meds = W.medicines(spark, d).groupBy("visit_id").agg(F.collect_list(F.when(F.col("l_linestatus") == "O", F.col("molecule"))).alias("medications"), F.collect_list(F.when(F.col("l_returnflag") != "N", F.col("form"))).alias("diagnosis"))
    rows = E.candidates(W.visits(spark, d).join(meds, "visit_id"), exclude_case=7, visit_type="Urgent")
    return rows.select("visit_id", "case_no", "visit_date", F.size("medications").cast("long").alias("n_meds"), F.size("diagnosis").cast("long").alias("n_dx"))


@query(f"""WITH {W.VISITS_SQL} SELECT visit_id, case_no, visit_date FROM visits WHERE visit_date < DATE '1997-01-01'""")
def p4_date_guard(spark, d):
    return E.before_encounter(W.visits(spark, d), F.lit("1997-01-01").cast("date")).select("visit_id", "case_no", "visit_date")


@query(f"""WITH {W.VISITS_SQL} SELECT visit_id FROM visits WHERE visit_date < DATE '1997-01-01' OR visit_id % 4 = 0""")
def p4_unreadable_dates(spark, d):
    """Candidates before a date; every fourth has a date that can't be read, and stays."""
    raw = F.when(F.col("visit_id") % 8 == 0, "31/02/1999").when(F.col("visit_id") % 8 == 4, F.lit(None)).otherwise(F.date_format("visit_date", "dd/MM/yyyy"))
    rows = W.visits(spark, d).withColumn("visit_date", D.clinical_date(raw))
    return E.before_encounter(rows, F.lit("1997-01-01").cast("date")).select("visit_id")


@query(f"""WITH {W.PATIENTS_SQL} SELECT case_no, age FROM patients WHERE abs(({W.band_sql('age')}) - ({W.band_sql('41')})) < 3""")
def p6_age_band_filter(spark, d):
    return W.patients(spark, d).where(V.ages_compatible(F.lit(41.0), F.col("age"))).select("case_no", "age")


@query(f"""WITH {W.VISITS_SQL}, {W.PATIENTS_SQL}, {W.MEDICINES_SQL}, keyed AS (SELECT case_no, visit_date, molecule, form, brand FROM medicines JOIN visits USING (visit_id)),
complaints AS (SELECT case_no, visit_date, string_agg(visit_reason, ', ' ORDER BY visit_reason) AS chief_complaints FROM visits GROUP BY ALL),
dx AS (SELECT case_no, visit_date, string_agg(form, ', ' ORDER BY form) AS diagnosis_names FROM keyed GROUP BY ALL),
rx AS (SELECT case_no, visit_date, string_agg(molecule, ', ' ORDER BY molecule) AS medicine_names FROM keyed GROUP BY ALL),
inv AS (SELECT case_no, visit_date, string_agg(brand, ', ' ORDER BY brand) AS investigation_names FROM keyed GROUP BY ALL)
SELECT v.visit_id, v.case_no, v.visit_date, visit_reason, gender, age, chief_complaints, diagnosis_names, medicine_names, investigation_names, row_number() OVER (PARTITION BY v.case_no ORDER BY v.visit_date DESC, v.visit_id DESC) = 1 AS is_latest
FROM visits v LEFT JOIN patients USING (case_no) LEFT JOIN complaints USING (case_no, visit_date) LEFT JOIN dx USING (case_no, visit_date) LEFT JOIN rx USING (case_no, visit_date) LEFT JOIN inv USING (case_no, visit_date)""")
def j1_encounter_assembly(spark, d):
    v = W.visits(spark, d)
    keyed = W.medicines(spark, d).join(v.select("visit_id", "case_no", "visit_date"), "visit_id").select("case_no", "visit_date", F.col("molecule").alias("medicine"), F.col("form").alias("diagnosis"), F.col("brand").alias("investigation"))
    complaints = E.ordered_text(v, ["case_no", "visit_date"], "visit_reason", "chief_complaints")
    return E.assemble(v, W.patients(spark, d), complaints, keyed, keyed, keyed)


@query(f"""WITH {W.VISITS_SQL}, {W.MEDICINES_SQL}, rx AS (SELECT visit_id, string_agg(molecule, ', ' ORDER BY molecule) AS medicine_names FROM medicines GROUP BY 1)
SELECT case_no, visit_id, visit_date, medicine_names FROM (SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY visit_date DESC, visit_id DESC) AS n FROM visits JOIN rx USING (visit_id) WHERE (medicine_names ILIKE '%red bolt%' OR medicine_names ILIKE '%small anvil%') AND case_no <> 7) WHERE n = 1""")
def j3_ilike_newest_per_patient(spark, d):
    rx = E.ordered_text(W.medicines(spark, d), ["visit_id"], "molecule", "medicine_names")
    rows = W.visits(spark, d).join(rx, "visit_id")
    return E.newest_matching(rows, ["Red Bolt", "small anvil"], "medicine_names", 7, [F.desc("visit_date"), F.desc("visit_id")]).select("case_no", "visit_id", "visit_date", "medicine_names")


@query(f"""WITH {W.VISITS_SQL} SELECT visit_id, case_no, visit_date FROM visits WHERE case_no = 7 AND visit_date < DATE '2000-01-01' ORDER BY visit_date""")
def j2_patient_history(spark, d):
    return E.past_visits(W.visits(spark, d), 7, F.lit("2000-01-01").cast("date")).select("visit_id", "case_no", "visit_date")


@query(f"""WITH {W.VISITS_SQL} SELECT visit_id, case_no, visit_date FROM visits WHERE case_no IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def j13_semi_lookup(spark, d):
    keys = W.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("case_no"))
    return E.lookup(W.visits(spark, d), keys, ["case_no"]).select("visit_id", "case_no", "visit_date")


@query(f"""WITH {W.VISITS_SQL} SELECT case_no, count(*) AS n_cases, string_agg(CAST(visit_id AS VARCHAR), ',' ORDER BY visit_id) AS visit_ids FROM visits WHERE case_no IN (1, 7, 11, 19) GROUP BY 1""")
def src_grouped_lookup(spark, d):
    rows = E.grouped_lookup(W.visits(spark, d).select("case_no", "visit_id"), [1, 7, 11, 19])
    return rows.select("case_no", F.size("cases").cast("long").alias("n_cases"), F.array_join(F.transform("cases", lambda c: c["visit_id"].cast("string")), ",").alias("visit_ids"))


@query(f"""WITH {W.VISITS_SQL}, {W.MEDICINES_SQL} SELECT case_no, string_agg(molecule, ', ' ORDER BY molecule) AS medicine_names FROM medicines JOIN visits USING (visit_id) GROUP BY 1""")
def a1_listagg(spark, d):
    rows = W.medicines(spark, d).join(W.visits(spark, d), "visit_id")
    return E.ordered_text(rows, ["case_no"], "molecule", "medicine_names")


@query(f"""WITH {W.VISITS_SQL}, {W.MEDICINES_SQL}, f AS (SELECT case_no, molecule, min(struct_pack(a := visit_date, b := visit_id, c := pos)) AS first FROM medicines JOIN visits USING (visit_id) GROUP BY ALL)
SELECT case_no, string_agg(molecule, ' > ' ORDER BY first, molecule) AS medicines FROM f GROUP BY 1""")
def a15_distinct_in_order(spark, d):
    rows = W.medicines(spark, d).join(W.visits(spark, d), "visit_id")
    return E.distinct_in_order(rows, "case_no", "molecule", ["visit_date", "visit_id", "pos"]).select("case_no", F.array_join("molecule", " > ").alias("medicines"))


@query(f"""WITH {W.VISITS_SQL} SELECT visit_id, case_no, visit_date, row_number() OVER (PARTITION BY case_no ORDER BY visit_date DESC, visit_id DESC) = 1 AS is_latest FROM visits""")
def w1_is_latest(spark, d):
    newest = F.row_number().over(Window.partitionBy("case_no").orderBy(F.desc("visit_date"), F.desc("visit_id")))
    return W.visits(spark, d).select("visit_id", "case_no", "visit_date", (newest == 1).alias("is_latest"))


@query(f"""WITH {W.VISITS_SQL} SELECT visit_id, case_no, len(h) AS n_past, array_to_string(list_sort(list_distinct(h)), ',') AS past_reasons FROM (SELECT visit_id, case_no, coalesce(list(visit_reason) OVER (PARTITION BY case_no ORDER BY visit_date, visit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS h FROM visits)""")
def w3_past_visits(spark, d):
    v = W.visits(spark, d)
    n = F.count("*").over(Window.partitionBy("case_no").orderBy("visit_date", "visit_id").rowsBetween(Window.unboundedPreceding, -1))
    return E.with_history(v, "visit_reason", "h", ["visit_date", "visit_id"]).withColumn("n_past", n).select("visit_id", "case_no", "n_past", F.array_join(F.array_sort("h"), ",").alias("past_reasons"))


@query(f"""WITH {W.VISITS_SQL}, s AS (SELECT o_orderkey AS visit_id, o_custkey AS case_no, o_totalprice AS score FROM orders), c AS (SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY score DESC, visit_id) AS n FROM s)
SELECT visit_id, case_no, score FROM c WHERE n <= 4 ORDER BY score DESC, visit_id LIMIT 12""")
def w4_capped_topk(spark, d):
    rows = W.table(spark, d, "orders").select(F.col("o_orderkey").alias("visit_id"), F.col("o_custkey").alias("case_no"), F.col("o_totalprice").alias("score"))
    return S.capped_top(rows, 12, [F.desc("score"), F.col("visit_id")])


@query("""SELECT o_orderkey AS case_id, final, diagnosis_sim, symptom_sim, visit_date FROM (SELECT *, o_custkey % 5 / 4.0 AS final, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 7 / 6.0 END AS diagnosis_sim, o_orderkey % 11 / 10.0 AS symptom_sim, CAST(o_orderdate AS DATE) AS visit_date FROM orders)
ORDER BY final DESC, coalesce(diagnosis_sim, -1) DESC, symptom_sim DESC, visit_date DESC, case_id LIMIT 50""")
def w5_multi_key_rank(spark, d):
    rows = W.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 5 / 4.0).alias("final"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 7 / 6.0).alias("diagnosis_sim"), (F.col("o_orderkey") % 11 / 10.0).alias("symptom_sim"), F.col("o_orderdate").cast("date").alias("visit_date")
    )
    return rows.orderBy(*S.ranking_order()).limit(50)


@query(f"""WITH {W.VISITS_SQL}, {W.MEDICINES_SQL}, rx AS (SELECT visit_id, string_agg(molecule, ', ' ORDER BY molecule) AS medicine_names FROM medicines GROUP BY 1)
SELECT case_no, arg_max(medicine_names, struct_pack(a := visit_date, b := visit_id)) AS medicine_names FROM visits JOIN rx USING (visit_id) GROUP BY 1""")
def w11_latest_prescription(spark, d):
    rx = E.ordered_text(W.medicines(spark, d), ["visit_id"], "molecule", "medicine_names")
    return E.latest_value(W.visits(spark, d).join(rx, "visit_id"), "medicine_names", ["visit_date", "visit_id"])


_UPDATES = """updates AS (SELECT o_custkey AS case_no, max(o_orderpriority) AS segment, max(o_totalprice) AS balance FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT s_suppkey + 100000000, 'NEW', s_acctbal FROM supplier)"""


def _updates(spark, d):
    old = W.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("case_no")).agg(F.max("o_orderpriority").alias("segment"), F.max("o_totalprice").alias("balance"))
    return old.unionByName(W.table(spark, d, "supplier").select((F.col("s_suppkey") + 100000000).alias("case_no"), F.lit("NEW").alias("segment"), F.col("s_acctbal").alias("balance")))


def _master(spark, d):
    return W.table(spark, d, "customer").select(F.col("c_custkey").alias("case_no"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


_MASTER = "master AS (SELECT c_custkey AS case_no, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer)"


@query(f"""WITH {_UPDATES}, {_MASTER} SELECT coalesce(m.case_no, u.case_no) AS case_no, name, CASE WHEN u.case_no IS NULL THEN m.segment ELSE u.segment END AS segment, CASE WHEN u.case_no IS NULL THEN m.balance ELSE u.balance END AS balance FROM master m FULL JOIN updates u ON m.case_no = u.case_no""")
def snk2_upsert(spark, d):
    return U.upsert(_master(spark, d), _updates(spark, d), ["case_no"])


@query(f"""WITH {_UPDATES} SELECT count(c_custkey) AS matched, count(*) - count(c_custkey) AS upserted FROM updates LEFT JOIN customer ON case_no = c_custkey""")
def snk2_upsert_counts(spark, d):
    return U.upsert_counts(_master(spark, d), _updates(spark, d), ["case_no"])


@query(f"""WITH {_UPDATES}, {_MASTER} SELECT m.case_no, name, CASE WHEN u.case_no IS NULL THEN m.segment ELSE u.segment END AS segment, m.balance FROM master m LEFT JOIN updates u ON m.case_no = u.case_no""")
def snk5_patch_column(spark, d):
    return U.patch_column(_master(spark, d), _updates(spark, d), "case_no", "segment")


@query("SELECT o_custkey, CAST(o_orderdate AS DATE) AS visit_date, count(*) AS count FROM orders GROUP BY ALL HAVING count(*) > 1")
def snk8_duplicate_keys(spark, d):
    return U.duplicate_keys(W.table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("visit_date")), ["o_custkey", "visit_date"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return W.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
