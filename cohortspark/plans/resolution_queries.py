"""Queries over the resolution of notes and terms: part names stand for phenotypes, brands for diseases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import encounters as E
from ..operators import medicines as M
from ..operators import ontology as O
from ..operators import resolution as R
from ..session import written
from . import views as W

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _ontology(spark, d, column, prefix):
    """Distinct values of a column as an ontology, numbered by the smallest part that has them."""
    names = W.table(spark, d, "part").groupBy(F.col(column).alias("label")).agg(F.min("p_partkey").alias("k"))
    none = F.array().cast("array<string>")
    terms = names.select(F.concat(F.lit(f"{prefix}:"), F.lpad(F.col("k").cast("string"), 7, "0")).alias("id"), "label", none.alias("synonyms"), F.lit("").alias("definition"), none.alias("alt_ids"))
    entries = written(O.search_entries(terms))
    return entries, O.token_postings(entries)


_HPO = "hpo AS (SELECT p_name AS label, min(p_partkey) AS k, 'HP:' || lpad(CAST(min(p_partkey) AS VARCHAR), 7, '0') AS id FROM part GROUP BY 1)"
_MONDO = "mondo AS (SELECT p_brand AS label, min(p_partkey) AS k, 'MONDO:' || lpad(CAST(min(p_partkey) AS VARCHAR), 7, '0') AS id FROM part GROUP BY 1)"


@query(f"""WITH {_HPO}, s AS (SELECT p_partkey, p_name, unnest([0, 1, 2, 3, 4]) AS pos FROM part)
SELECT p_partkey, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN p_name WHEN 1 THEN 'denies ' || p_name WHEN 2 THEN 'history of ' || p_name WHEN 3 THEN 'possible ' || p_name ELSE 'mother had ' || p_name END AS segment, CASE pos WHEN 0 THEN 'affirmed' WHEN 1 THEN 'negated' WHEN 2 THEN 'historical' WHEN 3 THEN 'uncertain' ELSE 'family' END AS assertion_status, pos = 0 AS is_pheno,
CASE WHEN pos = 0 THEN id END AS hpo_id, CASE WHEN pos = 0 THEN k END AS hpo_code FROM s JOIN hpo ON p_name = label""")
def n4_note_phenotypes(spark, d):
    """Notes cut into segments: their assertion, whether they are phenotypes, and the code of those that are."""
    text = F.concat_ws("\n", F.concat(F.lit("● "), "p_name"), F.concat(F.lit("* denies "), "p_name"), F.concat(F.lit("history of "), "p_name", F.lit(" .")), F.concat(F.lit("possible "), "p_name"), F.concat(F.lit("mother had "), "p_name"), F.lit(" . "))
    notes = W.table(spark, d, "part").select("p_partkey", text.alias("note"))
    return R.processed_notes(notes, ["p_partkey"], *_ontology(spark, d, "p_name", "HP"), normalize=False).drop("embedding")


@query(f"""WITH {_HPO}, {_MONDO}, t AS (SELECT DISTINCT unnest([p_name, 'denies ' || p_name, p_brand, 'loss of appetite']) AS term FROM part)
SELECT term, CASE WHEN starts_with(term, 'denies ') THEN 'negated' ELSE 'affirmed' END AS assertion_status, h.id AS hpo_id, CASE WHEN h.id IS NOT NULL THEN CAST(1.0 AS DOUBLE) END AS hpo_score, m.id AS mondo_id FROM t LEFT JOIN hpo h ON h.label = replace(term, 'denies ', '') LEFT JOIN mondo m ON m.label = term""")
def n6_two_ontologies(spark, d):
    """Terms resolved in two ontologies at once, abstaining where a hit is weak."""
    terms = W.table(spark, d, "part").select(F.explode(F.array(F.col("p_name"), F.concat(F.lit("denies "), "p_name"), F.col("p_brand"), F.lit("loss of appetite"))).alias("term"))
    found = R.resolved(terms, {"hpo": _ontology(spark, d, "p_name", "HP"), "mondo": _ontology(spark, d, "p_brand", "MONDO")})
    return found.select("term", "assertion_status", "hpo_id", "hpo_score", "mondo_id")


@query(f"""WITH {_HPO}, t AS (SELECT DISTINCT unnest([p_name, 'denies ' || p_name, 'history of ' || p_name]) AS term FROM part) SELECT term, id FROM t JOIN hpo ON label = replace(term, 'history of ', '') WHERE NOT starts_with(term, 'denies ')""")
def n5_search_without_negated(spark, d):
    terms = W.table(spark, d, "part").select(F.explode(F.array(F.col("p_name"), F.concat(F.lit("denies "), "p_name"), F.concat(F.lit("history of "), "p_name"))).alias("term"))
    return R.assertion_search(terms, *_ontology(spark, d, "p_name", "HP"), k=1, filter_negated=True).select("term", "id")


@query(f"""WITH {_HPO}, {_MONDO} SELECT p_partkey, p_name || '|' || 'no ' || p_name || '|' || p_name AS symptoms, h.id || '|' || h.id || '|' || h.id AS codes, 'false|true|false' AS negated, p_name || '|' || p_name AS presenting, 'no ' || p_name AS negatives, m.id AS dx FROM part JOIN hpo h ON h.label = p_name JOIN mondo m ON m.label = p_brand""")
def n7_decorated_cases(spark, d):
    """Cases whose symptoms and diagnoses become structs with codes and flags, in order, repeats kept."""
    cases = W.table(spark, d, "part").select("p_partkey", F.array(F.col("p_name"), F.concat(F.lit(" no "), "p_name"), F.lit(" "), F.col("p_name")).alias("symptoms"), F.array(F.concat(F.lit("- "), F.lit("xx "), "p_brand")).alias("raw"), F.array("p_brand").alias("diagnosis"))
    # the cleaning of diagnoses ends at the last letter, so they are matched by their numbers' words
    mondo = W.table(spark, d, "part").groupBy(F.col("p_brand").alias("label")).agg(F.min("p_partkey").alias("k"))
    words = F.concat(F.lit("type "), F.translate(F.substring("label", 7, 3), "0123456789", "abcdefghij"))
    none = F.array().cast("array<string>")
    entries = written(O.search_entries(mondo.select(F.concat(F.lit("MONDO:"), F.lpad(F.col("k").cast("string"), 7, "0")).alias("id"), words.alias("label"), none.alias("synonyms"), F.lit("").alias("definition"), none.alias("alt_ids"))))
    cases = cases.withColumn("diagnosis", F.transform("diagnosis", lambda b: F.concat(F.lit("- type "), F.translate(F.substring(b, 7, 3), "0123456789", "abcdefghij"), F.lit(" ."))))
    out = R.decorate_cases(cases, ["p_partkey"], _ontology(spark, d, "p_name", "HP"), (entries, O.token_postings(entries)))
    joined = lambda c, f: F.array_join(F.transform(c, lambda s: s[f].cast("string")), "|")
    return out.select("p_partkey", joined("symptoms", "term").alias("symptoms"), joined("symptoms", "code").alias("codes"), joined("symptoms", "is_negated").alias("negated"), joined(R.presenting(F.col("symptoms")), "term").alias("presenting"), joined(R.pertinent_negatives(F.col("symptoms")), "term").alias("negatives"), joined("diagnosis", "code").alias("dx"))


@query(f"""WITH {_HPO} SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'HP:0000777' WHEN 1 THEN 'HP:0000042' ELSE id END AS curie, CAST(CASE p_partkey % 3 WHEN 0 THEN 777 WHEN 1 THEN 42 ELSE k END AS BIGINT) AS code FROM part JOIN hpo ON label = p_name""")
def h4_filled_codes(spark, d):
    """Codes and identifiers filled from each other, and from a search only where both are missing."""
    k = F.col("p_partkey") % 3
    rows = W.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("term"), F.when(k == 0, F.lit(777)).cast("long").alias("code"), F.when(k == 1, "HP:0000042").alias("curie"))
    return R.filled_codes(rows, *_ontology(spark, d, "p_name", "HP"), "HP").select("p_partkey", "curie", "code")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'term' WHEN 1 THEN 'original' WHEN 2 THEN 'brand' WHEN 3 THEN 'name' END AS name FROM part WHERE p_partkey % 5 <> 4""")
def h2_medicine_names(spark, d):
    """What a medicine is called, by the precedence of its fields."""
    k = F.col("p_partkey") % 5
    given = lambda n, text: F.when(k <= n, F.lit(text))
    med = F.struct(given(0, " term ").alias("term"), F.coalesce(given(1, "original"), F.lit(" ")).alias("original_term"), given(2, "brand").alias("brand_name"), given(3, "name").alias("name"))
    rows = W.table(spark, d, "part").select("p_partkey", F.array(med).alias("medications"))
    return rows.select("p_partkey", F.explode(M.medicine_names("medications", rows)).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '|' || p_brand WHEN 1 THEN p_name ELSE '' END AS molecules FROM part""")
def t21_split_combinations(spark, d):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit(" "), "p_name", F.lit(" +  "), "p_brand", F.lit(" + "))).when(k == 1, F.col("p_name"))
    return W.table(spark, d, "part").select("p_partkey", F.array_join(M.molecules_of(text), "|").alias("molecules"))


@query("""SELECT p_partkey, p_name AS term, p_brand AS inner_term FROM part""")
def p9_without_embeddings(spark, d):
    """Rows without vectors, wherever these stand in nested columns."""
    vector = F.array(F.lit(1.0), F.lit(2.0))
    inner = F.struct(F.col("p_brand").alias("term"), vector.alias("embedding"))
    rows = W.table(spark, d, "part").select("p_partkey", vector.alias("embedding"), F.array(F.struct(F.col("p_name").alias("term"), vector.alias("embedding"), F.array(inner).alias("parts"))).alias("symptoms"))
    bare = M.without_field(rows)
    if "embedding" in bare.schema.simpleString():
        raise ValueError("a vector is left")
    return bare.select("p_partkey", F.col("symptoms")[0]["term"].alias("term"), F.col("symptoms")[0]["parts"][0]["term"].alias("inner_term"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN vec_id % 3 = 0 THEN x WHEN vec_id % 3 = 1 THEN (x + 1.0) / 2 END) AS m FROM v)
SELECT vec_id, round(m[1], 6) AS first, round(list_sum(list_transform(m, lambda x: x * x)), 6) AS square, CASE WHEN vec_id % 3 <> 2 THEN CAST(1.0 AS DOUBLE) END AS unit_square FROM p""")
def v14_mean_pooling(spark, d):
    """Token vectors pooled under a mask, and scaled to length 1."""
    e = F.col("embedding").cast("array<double>")
    ones = F.transform(e, lambda x: F.lit(1.0))
    k = F.col("vec_id") % 3
    mask = F.when(k == 0, F.array(F.lit(1), F.lit(0))).when(k == 1, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(0)))
    rows = W.table(spark, d, "embeddings").select("vec_id", V.mean_pooled(F.array(e, ones), mask).alias("m"))
    return rows.select("vec_id", F.round(F.get("m", F.lit(0)), 6).alias("first"), F.round(F.when(F.col("m").isNotNull(), V.dot(F.col("m"), F.col("m"))), 6).alias("square"), F.when(F.col("m").isNotNull(), F.round(V.dot(V.unit(F.col("m")), V.unit(F.col("m"))), 6)).alias("unit_square"))


@query(f"""WITH {W.VISITS_SQL}, {W.PATIENTS_SQL}, {W.MEDICINES_SQL}, one AS (SELECT min(o_custkey) AS case_no FROM orders), k AS (SELECT DISTINCT case_no, visit_date FROM visits JOIN one USING (case_no)),
m AS (SELECT case_no, visit_date, molecule, form FROM medicines JOIN visits USING (visit_id) JOIN one USING (case_no)),
dx AS (SELECT case_no, visit_date, string_agg(form, ', ' ORDER BY form) AS diagnosis_names FROM m GROUP BY ALL), rx AS (SELECT case_no, visit_date, string_agg(molecule, ', ' ORDER BY molecule) AS medicine_names FROM m GROUP BY ALL)
SELECT v.visit_id, v.visit_date, gender, age, v.visit_reason, c.visit_reason AS chief_complaints, diagnosis_names, medicine_names FROM visits v JOIN one USING (case_no) LEFT JOIN patients USING (case_no) LEFT JOIN visits c ON c.case_no = v.case_no AND c.visit_date = v.visit_date LEFT JOIN dx ON dx.case_no = v.case_no AND dx.visit_date = v.visit_date LEFT JOIN rx ON rx.case_no = v.case_no AND rx.visit_date = v.visit_date WHERE v.visit_date < DATE '1998-06-01'""")
def j2_full_history(spark, d):
    """One case's visits before a date with patient, complaints, diagnoses and medicines."""
    visits = W.visits(spark, d)
    case_no = visits.agg(F.min("case_no")).first()[0]
    keyed = W.medicines(spark, d).join(visits.select("visit_id", "case_no", "visit_date"), "visit_id")
    complaints = visits.select("case_no", "visit_date", F.col("visit_reason").alias("chief_complaints"))
    history = E.patient_history(visits, W.patients(spark, d), complaints, keyed.select("case_no", "visit_date", F.col("form").alias("diagnosis")), keyed.select("case_no", "visit_date", F.col("molecule").alias("medicine")), case_no, F.lit("1998-06-01").cast("date"))
    return history.select("visit_id", "visit_date", "gender", "age", "visit_reason", "chief_complaints", "diagnosis_names", "medicine_names")


@query(f"""WITH {W.VISITS_SQL} SELECT visit_id, visit_date FROM visits WHERE case_no = (SELECT min(o_custkey) FROM orders) AND visit_date = (SELECT min(CAST(o_orderdate AS DATE)) FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)) LIMIT 1""")
def src10_point_lookup(spark, d):
    """One encounter by case and date."""
    visits = W.visits(spark, d)
    first = visits.agg(F.min(F.struct("case_no", "visit_date")).alias("s")).first()["s"]
    return E.first_case(visits, first["case_no"], F.lit(first["visit_date"])).select("visit_id", "visit_date")


@query("""SELECT count(DISTINCT p_name) AS n FROM part""")
def src15_master_count(spark, d):
    from .clinical_queries import _master

    return _master(spark, d).agg(F.count("*").alias("n"))
