"""Queries over the composite operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import medicines as M
from ..session import written
from . import views as W
from . import workflows as P
from .clinical_queries import _MASTER_SQL, _master
from .ranking_queries import _TOP, _evidence

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(_TOP + """, k AS (SELECT query_id, molecule, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frequency DESC, avg_similarity DESC, molecule) AS rank FROM agg)
SELECT q.query_id, coalesce(string_agg(molecule, ', ' ORDER BY rank) FILTER (rank <= 5), '') AS molecules FROM (SELECT CAST(unnest(range(6)) AS INTEGER) AS query_id) q LEFT JOIN k ON q.query_id = k.query_id GROUP BY 1""")
def q5_entity_matrix(spark, d):
    cases = W.visits(spark, d).join(W.patients(spark, d), "case_no").select(F.col("visit_id").alias("case_id"), "age", "gender")
    meds = W.medicines(spark, d).select(F.col("visit_id").alias("case_id"), "pos", "molecule", "brand", "is_fdc")
    entities = spark.range(6).select(F.col("id").cast("int").alias("query_id"))
    matrix = P.entity_matrix(entities, _evidence(spark, d), cases, meds, ["query_id"], age=F.lit(41.0))
    return matrix.select("query_id", F.array_join("molecules", ", ").alias("molecules"))


@query(f"""WITH {W.VISITS_SQL}, {W.PATIENTS_SQL}, {W.MEDICINES_SQL}, {_MASTER_SQL}, v AS (SELECT * FROM visits QUALIFY row_number() OVER (PARTITION BY case_no, visit_date ORDER BY visit_id) = 1),
rx AS (SELECT case_no, visit_date, count(*) AS n_medications, count(*) FILTER (ordinal IS NOT NULL) AS n_known FROM medicines JOIN visits USING (visit_id) LEFT JOIN master ON molecule = canonical_molecule GROUP BY ALL)
SELECT case_no, visit_date, gender, CAST(1 AS BIGINT) AS n_symptoms, coalesce(n_medications, 0) AS n_medications, coalesce(n_known, 0) AS n_known FROM v LEFT JOIN patients USING (case_no) LEFT JOIN rx USING (case_no, visit_date)""")
def q7_migration(spark, d):
    visits = W.visits(spark, d)
    keyed = W.medicines(spark, d).join(visits.select("visit_id", "case_no", "visit_date"), "visit_id")
    first = visits.groupBy("case_no", "visit_date").agg(F.min_by(F.struct("visit_reason", "visit_id"), "visit_id").alias("s")).select("case_no", "visit_date", "s.*")
    sources = {
        "visits": first, "patients": W.patients(spark, d), "complaints": first.select("case_no", "visit_date", F.col("visit_reason").alias("chief_complaints")),
        "diagnoses": keyed.select("case_no", "visit_date", F.col("form").alias("diagnosis")), "prescriptions": keyed.select("case_no", "visit_date", F.col("molecule").alias("medicine")),
    }
    plain = lambda terms: terms.withColumn("label", F.lower("term"))
    cases = P.migrate(sources, None, {"symptoms": plain, "diagnosis": plain, "medications": P.medicine_resolver(_master(spark, d), ["brand_name", "canonical_molecule"])})
    known = F.size(F.filter("medications", lambda m: m["canonical_molecule"].isNotNull()))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return cases.select("case_no", "visit_date", "gender", n(size("symptoms")).alias("n_symptoms"), n(size("medications")).alias("n_medications"), n(F.when(F.col("medications").isNotNull(), known)).alias("n_known"))


@query(f"""WITH {_MASTER_SQL} SELECT brand_name, canonical_molecule, canonical_molecule || ', marketed as ' || brand_name || ', is used as ' || form || ' therapy.' AS digest_text FROM master""")
def q8_medicine_digests(spark, d):
    master = _master(spark, d).withColumn("clinical_dosing_indication", F.concat(F.col("form"), F.lit(" therapy")))
    return M.with_digest(master).select("brand_name", "canonical_molecule", "digest_text")


@query(f"""WITH {W.VISITS_SQL}, v AS (SELECT visit_id, case_no, visit_date, visit_reason, lag(visit_reason) OVER (PARTITION BY case_no ORDER BY visit_date, visit_id) AS latest FROM visits) SELECT visit_id, coalesce(latest, '') AS latest FROM v""")
def q9_encounter_context(spark, d):
    v = W.visits(spark, d)
    # the date carries the visit's number as microseconds, so that visits of one day keep an order
    stamp = F.timestamp_micros(F.unix_micros(F.col("visit_date").cast("timestamp")) + F.col("visit_id"))
    rows = v.select("visit_id", "case_no", stamp.alias("visit_date"), F.array(F.col("visit_reason")).alias("symptoms"), F.array().cast("array<string>").alias("diagnoses"), F.array("visit_reason").alias("medications"))
    return P.encounter_context(rows).select("visit_id", F.coalesce(F.array_join("latest_documented_prescription", ", "), F.lit("")).alias("latest"))


@query(f"""WITH {W.VISITS_SQL}, {W.MEDICINES_SQL}, v AS (SELECT visit_id, case_no, visit_date, visit_reason, coalesce(list(DISTINCT form) FILTER (form IS NOT NULL), []) AS forms FROM visits LEFT JOIN medicines USING (visit_id) GROUP BY ALL),
h AS (SELECT *, list_distinct(coalesce(flatten(list(forms) OVER w), [])) AS past_dx, list_distinct(coalesce(list(lower(visit_reason)) OVER w, [])) AS past_s FROM v WINDOW w AS (PARTITION BY case_no ORDER BY visit_date, visit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT visit_id, len(past_dx) AS n_past, array_to_string(list_sort(list_filter(forms, lambda x: NOT list_contains(past_dx, x))), ',') AS new_diagnoses, array_to_string(list_sort(list_transform(list_filter(past_dx, lambda x: NOT list_contains(forms, x)), lambda x: lower(x))), ',') AS stop_diagnoses, array_to_string(list_sort(list_intersect(forms, past_dx)), ',') AS maintained_diagnoses FROM h""")
def q9_context_delta(spark, d):
    """Every visit against all earlier visits of its case: diagnoses that are new, kept or gone."""
    forms = W.medicines(spark, d).groupBy("visit_id").agg(F.array_sort(F.collect_set("form")).alias("diagnoses"))
    v = W.visits(spark, d).join(forms, "visit_id", "left")
    stamp = F.timestamp_micros(F.unix_micros(F.col("visit_date").cast("timestamp")) + F.col("visit_id"))
    none = F.array().cast("array<string>")
    rows = v.select("visit_id", "case_no", stamp.alias("visit_date"), none.alias("symptoms"), F.coalesce("diagnoses", none).alias("diagnoses"), none.alias("medications"))
    out = P.encounter_context(rows)
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return out.select("visit_id", F.size("past_diagnoses").cast("long").alias("n_past"), joined("new_diagnoses"), joined("stop_diagnoses"), joined("maintained_diagnoses"))


@query(f"""WITH {W.VISITS_SQL}, {W.MEDICINES_SQL}, {_MASTER_SQL}, names AS (SELECT p_name AS label, 'HP:' || lpad(CAST(min(p_partkey) AS VARCHAR), 7, '0') AS id FROM part GROUP BY 1),
v AS (SELECT * FROM visits QUALIFY row_number() OVER (PARTITION BY case_no, visit_date ORDER BY visit_id) = 1), rx AS (SELECT case_no, visit_date, string_agg(n.id, ',' ORDER BY molecule) AS codes, string_agg(brand_name || '/' || canonical_molecule, ',' ORDER BY molecule || ' 5mg') AS meds FROM medicines JOIN visits USING (visit_id) JOIN names n ON n.label = molecule JOIN master ON canonical_molecule = molecule GROUP BY ALL)
SELECT case_no, visit_date, coalesce(codes, '') AS codes, coalesce(codes, '') AS negated_codes, coalesce(meds, '') AS medicines FROM v LEFT JOIN rx USING (case_no, visit_date)""")
def q7_migration_resolved(spark, d):
    """Ingestion with real resolvers: diagnoses by an ontology, symptoms that are denied by what they deny, medicines by the master."""
    from ..operators import ontology as O

    none = F.array().cast("array<string>")
    terms = W.table(spark, d, "part").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("k")).select(F.concat(F.lit("HP:"), F.lpad(F.col("k").cast("string"), 7, "0")).alias("id"), "label", none.alias("synonyms"), F.lit("").alias("definition"), none.alias("alt_ids"))
    entries = written(O.search_entries(terms))
    resolver = P.ontology_resolver(entries, O.token_postings(entries), "strict")
    visits = W.visits(spark, d)
    keyed = W.medicines(spark, d).join(visits.select("visit_id", "case_no", "visit_date"), "visit_id")
    first = visits.groupBy("case_no", "visit_date").agg(F.min_by(F.struct("visit_reason", "visit_id"), "visit_id").alias("s")).select("case_no", "visit_date", "s.*")
    complaints = keyed.groupBy("case_no", "visit_date").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("denies "), "molecule"))), "\n").alias("chief_complaints"))
    sources = {
        "visits": first, "patients": W.patients(spark, d), "complaints": complaints,
        "diagnoses": keyed.select("case_no", "visit_date", F.col("molecule").alias("diagnosis")), "prescriptions": keyed.select("case_no", "visit_date", F.concat("molecule", F.lit(" 5mg")).alias("medicine")),
    }
    cases = P.migrate(sources, None, {"symptoms": resolver, "diagnosis": resolver, "medications": P.medicine_resolver(_master(spark, d), ["brand_name", "canonical_molecule"])})
    listed = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit(""))
    denied = F.filter("symptoms", lambda s: s["is_negated"])
    return cases.select("case_no", "visit_date", listed("diagnosis", lambda s: s["curie"]).alias("codes"), listed(denied, lambda s: s["curie"]).alias("negated_codes"), listed("medications", lambda m: F.concat(m["brand_name"], F.lit("/"), m["canonical_molecule"])).alias("medicines"))
