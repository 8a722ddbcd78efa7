"""Queries over the assessment of complaints, the contracts of answers, and the steps of prescribing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as N
from ..operators import assessment as A
from ..operators import delta as D
from . import composites as C
from . import views as W
from .clinical_queries import _MASTER_SQL, _PHRASES, _master, _phrases

QUERIES, ORACLE_SQL = {}, {}
PAST = ("view", "severe error")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _encounters(spark, d):
    """One complaint an event, with two past terms for all but every seventh."""
    rows = _phrases(spark, d)
    past = F.when(F.col("event_id") % 7 != 0, F.array(*map(F.lit, PAST))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return rows.select("event_id", "event_type", F.array("text", F.lit(" ")).alias("symptoms"), none.alias("diagnoses"), past.alias("past_symptoms"), none.alias("past_diagnoses"), F.lit(41.0).alias("age"), F.lit("F").alias("gender"), F.lit("follow-up").alias("visit_type"))


# the complaint of an event, what it is matched with, its category, entity and status, by the phrase that it got
_MARKS = f"""WITH p AS (SELECT *, event_id % {len(_PHRASES)} AS k, event_id % 7 <> 0 AS seen, event_type IN ('view', 'error') AS known, CASE event_type WHEN 'view' THEN 'view' WHEN 'error' THEN 'severe error' END AS past FROM events),
m AS (SELECT *, CASE WHEN k IN (0, 1) THEN 'non_symptom' WHEN k IN (2, 6, 7) THEN 'global_status' WHEN k IN (3, 4, 9) THEN 'negated_symptom' ELSE 'symptom' END AS category,
CASE k WHEN 0 THEN 'Informant: patient' WHEN 1 THEN 'labs advised' WHEN 2 THEN 'feels much better' WHEN 3 THEN 'denies ' || event_type || ' currently' WHEN 4 THEN event_type || ' resolved' WHEN 5 THEN 'moderate ' || event_type WHEN 6 THEN 'no complaints' WHEN 7 THEN 'nil' WHEN 8 THEN event_type WHEN 9 THEN 'free of ' || event_type ELSE 'worse ' || event_type END AS complaint FROM p WHERE k <> 10),
a AS (SELECT *, CASE WHEN category = 'negated_symptom' THEN event_type WHEN category = 'symptom' THEN complaint END AS entity, CASE WHEN category = 'negated_symptom' THEN 'stop' WHEN category = 'symptom' THEN CASE WHEN NOT (seen AND known) THEN 'new' WHEN k = 11 THEN 'increased' ELSE 'maintained' END END AS status, CASE WHEN seen AND known AND category IN ('symptom', 'negated_symptom') THEN past END AS matched FROM m),
s AS (SELECT *, CASE status WHEN 'stop' THEN 'resolved' WHEN 'increased' THEN 'worsened' WHEN 'maintained' THEN 'maintained' WHEN 'new' THEN 'new' ELSE category END AS shown FROM a)
"""


@query(_MARKS + "SELECT event_id, complaint, category, entity, matched, status, shown FROM s")
def n15_keyword_marks(spark, d):
    rows = A.keyword_marks(_encounters(spark, d)).select("event_id", F.explode("marks").alias("m"))
    return rows.select("event_id", "m.complaint", "m.category", F.col("m.canonical_entity").alias("entity"), F.col("m.matched_past").alias("matched"), "m.status", F.col("m.display_status").alias("shown"))


@query(
    _MARKS
    + """SELECT event_id, category, CASE category WHEN 'negated_symptom' THEN 'Resolved / negated (' || complaint || ')' WHEN 'symptom' THEN CASE WHEN matched IS NOT NULL THEN shown || ', changed from ' || matched ELSE 'new symptom' END WHEN 'global_status' THEN 'Whole-patient condition statement (global status)' ELSE 'Administrative metadata or clinical directive (non-symptom)' END AS change_description,
CASE WHEN category = 'symptom' THEN entity ELSE '' END AS active, CASE WHEN category = 'negated_symptom' THEN entity ELSE '' END AS resolved, CASE WHEN category = 'global_status' THEN 'Overall status: ' || complaint WHEN seen THEN 'Follow-up consultation review' ELSE 'Initial baseline consultation' END AS patient_condition,
CASE category WHEN 'symptom' THEN entity || ': ' || CASE WHEN matched IS NOT NULL THEN shown || ', changed from ' || matched ELSE 'new symptom' END WHEN 'negated_symptom' THEN entity || ': resolved / denied' WHEN 'global_status' THEN 'Patient reports ' || lower(complaint) ELSE 'No active symptoms reported.' END AS symptom_notes FROM s"""
)
def n17_keyword_assessment(spark, d):
    """The assessment without a model."""
    rows = A.keyword_assessment(A.keyword_marks(_encounters(spark, d))).where(F.size("triaged_items") > 0)
    item = F.col("triaged_items")[0]
    return rows.select("event_id", item["category"].alias("category"), item["change_description"].alias("change_description"), F.array_join("active_symptoms", ",").alias("active"), F.array_join("resolved_symptoms", ",").alias("resolved"), "patient_condition", "symptom_notes")


@query(_MARKS + """SELECT event_id, 'symptom' AS entity_type, status, CASE WHEN category = 'negated_symptom' AND matched IS NOT NULL THEN matched ELSE entity END AS entity FROM s WHERE category IN ('symptom', 'negated_symptom') AND (seen OR category = 'symptom')""")
def n13_assessed_delta(spark, d):
    """The delta that triaged items give: denied symptoms under their past terms, all active ones new without history."""
    rows = A.assessed_delta(A.assessed(A.keyword_marks(_encounters(spark, d))))
    return D.long_form(rows, ["event_id"])


@query("""SELECT event_id, status, event_type AS entity FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'decreased' WHEN 1 THEN 'increased' WHEN 2 THEN 'stop' ELSE 'new' END AS status FROM events)""")
def n13_delta_of_results(spark, d):
    """The delta that older results (complaint, confirmed_status) give, an unknown status counting as new."""
    rows = _encounters(spark, d).withColumn("past_symptoms", F.array(F.lit("view")))
    word = F.element_at(F.array(*map(F.lit, ("decreased", "increased", "stop", "odd"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = rows.withColumn("results", F.array(F.struct(F.col("event_type").alias("complaint"), word.alias("confirmed_status"))))
    return D.long_form(A.assessed_delta(rows.withColumn("symptoms", F.array().cast("array<string>")), None, "results"), ["event_id"]).select("event_id", "status", "entity")


def _answers(spark, d):
    """Encounters with a model's answer: for every third a corrected item, for every third prose, for the others none."""
    # rows with a mark, told by what is marked: a filter on the marks would have them computed twice
    rows = A.keyword_marks(_encounters(spark, d).where(F.exists("symptoms", lambda s: F.trim(s) != "")))
    name = F.col("marks")[0]["complaint"]
    item = F.concat(F.lit('{"raw_text": "'), F.upper(name), F.lit('", "category": "Symptom", "canonical_entity": " '), F.col("event_type"), F.lit(' ", "status": "Improving", "notes": "better"}'))
    answer = F.concat(F.lit('```json\n{"patient_condition": "stable", "symptom_notes": "n", "whats_changed": "w", "triaged_items": ['), item, F.lit('], "deprescribing_recommendations": [{"drug": "A", "status": "resolved"}, {"medicine": "B", "action": "decreased"}], "actual_discontinuation": [" C ", ""]}\n```'))
    k = F.col("event_id") % 3
    return rows.withColumn("answer", F.when(k == 0, answer).when(k == 1, "sorry, no answer"))


@query(_MARKS + """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'symptom' ELSE category END AS category, CASE WHEN event_id % 3 = 0 THEN event_type ELSE entity END AS entity, CASE WHEN event_id % 3 = 0 THEN 'decreased' ELSE status END AS status, CASE WHEN event_id % 3 = 0 THEN 'improved' ELSE shown END AS shown, event_id % 3 = 0 AND (shown <> 'improved' OR category <> 'symptom') AS changed, event_id % 3 = 0 AS used_llm, CASE WHEN event_id % 3 = 0 THEN 'w' ELSE '' END AS whats_changed FROM s""")
def n15_assessed_with_answers(spark, d):
    """Marks merged with answers: valid answers win, prose and missing ones leave the keywords' marks."""
    rows = A.assessed(_answers(spark, d), "answer")
    i = F.col("triaged_items")[0]
    return rows.select("event_id", i["category"].alias("category"), i["canonical_entity"].alias("entity"), i["status"].alias("status"), i["display_status"].alias("shown"), i["changed"].alias("changed"), "used_llm", "whats_changed")


@query(_MARKS + """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'C,A' ELSE '' END AS discontinued, CASE WHEN event_id % 3 = 0 THEN 'w' ELSE 'No medication changes required; continuing current clinical management.' END AS whats_changed, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS n_recommendations,
'case type: follow up visit' || chr(10) || 'patient age: 41 yrs' || chr(10) || 'patient gender: f' || chr(10) || CASE WHEN k = 0 THEN 'informant: patient' || chr(10) ELSE '' END || chr(10) || 'current visit chief complains:' || chr(10) || CASE WHEN event_id % 3 = 0 THEN '- ' || complaint || ' (improved)' WHEN category = 'symptom' THEN '- ' || complaint || ' (' || shown || ')' WHEN category = 'negated_symptom' THEN '- ' || entity || ' (resolved / denied)' ELSE '- no active symptoms reported' END || chr(10) || chr(10) || 'current diagnosis:' || chr(10) || 'none recorded' || chr(10) || chr(10) || 'clinical notes:' || chr(10)
|| CASE WHEN event_id % 3 = 0 THEN 'n' ELSE CASE category WHEN 'symptom' THEN entity || ': ' || CASE WHEN matched IS NOT NULL THEN shown || ', changed from ' || matched ELSE 'new symptom' END WHEN 'negated_symptom' THEN entity || ': resolved / denied' WHEN 'global_status' THEN 'Patient reports ' || lower(complaint) ELSE 'No active symptoms reported.' END END AS summary FROM s""")
def q9_deprescribe_step(spark, d):
    """The first step of prescribing: discontinued medicines, what changed, and the summary of the encounter."""
    rows = C.deprescribe_step(_answers(spark, d).drop("marks"), "answer")
    return rows.select("event_id", F.array_join("actual_discontinuation", ",").alias("discontinued"), "whats_changed", F.size("deprescribing_recommendations").alias("n_recommendations"), F.col("clinical_summary").alias("summary"))


@query(_MARKS + """SELECT event_id, complaint, complaint AS raw, shown AS llm_status, category AS llm_category, shown AS heuristic_mark, FALSE AS changed, 'Heuristic triage: ' || category AS notes FROM s""")
def h9_triage_report(spark, d):
    rows = A.keyword_assessment(A.keyword_marks(_encounters(spark, d)))
    each = rows.select("event_id", F.explode(A.triage_report(F.col("triaged_items"))).alias("r"), F.col("triaged_items")[0]["raw_text"].alias("raw"))
    return each.select("event_id", "r.complaint", "raw", "r.llm_status", "r.llm_category", "r.heuristic_mark", "r.changed", "r.notes")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'stop' WHEN 1 THEN 'increased' WHEN 2 THEN 'maintained' WHEN 3 THEN 'decreased' ELSE 'new' END AS status FROM events""")
def n18_delta_status(spark, d):
    """A term that stands in several lists gets the status of the first in priority; one in none goes by its words."""
    k, low = F.col("event_id") % 5, F.col("event_type")
    empty = F.array().cast("array<string>")
    put = lambda *which: F.when(k.isin(*which), F.array(F.upper(low))).otherwise(empty)
    rows = W.table(spark, d, "events").select(
        "event_id", "event_type", empty.alias("decreased_symptoms"), put(1).alias("increased_symptoms"), put(0, 1).alias("stop_symptoms"), put(1, 2).alias("maintained_symptoms"), put(4).alias("new_symptoms"), empty.alias("stop_diagnoses"), put(0).alias("maintained_diagnoses"), empty.alias("new_diagnoses"),
    )
    term = F.when(k == 3, F.concat(F.lit("mild "), low)).otherwise(low)
    return rows.select("event_id", D.delta_status(term, F.array(low)).alias("status"))


@query("""SELECT p_partkey, 'cond ' || p_type AS patient_condition, p_name AS changed, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS item, 'Unknown|General presentation|maintained|maintained' AS defaults, 'x|y' AS in_use FROM part""")
def contract_triage(spark, d):
    """The triage contract under either name of its items, defaults for what recommendations lack."""
    p = W.spread(W.table(spark, d, "part"), "p_partkey")
    item = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"triaged_items": [{"raw_text": "'), "p_name", F.lit('"}, {"raw_text": " "}]'))).otherwise(F.concat(F.lit('"triaged_items": [], "symptoms": [{"complaint": "'), "p_brand", F.lit('"}]')))
    text = F.concat(F.lit('Sure.\n```json\n{"patient_condition": " cond '), "p_type", F.lit('", "summary": "'), "p_name", F.lit('", "recommendations": [{"rationale": "r"}], "patient_reported_current_use": [" x", "", "y"], '), item, F.lit("}\n```"))
    a = p.select("p_partkey", N.triage_answer(text).alias("a"))
    r = F.col("a.deprescribing_recommendations")[0]
    return a.select("p_partkey", "a.patient_condition", F.col("a.whats_changed").alias("changed"), F.col("a.triaged_items")[0]["name"].alias("item"), F.concat_ws("|", r["medicine"], r["target_symptom"], r["status_change"], r["action"]).alias("defaults"), F.array_join("a.patient_reported_current_use", "|").alias("in_use"))


@query("""SELECT p_partkey, p_type AS whats_changed, p_name || '|' || p_brand || '|' || 'plain' AS molecules, p_name || 'x' AS entity FROM part""")
def contract_med_check(spark, d):
    """The medication check contract: molecules as objects of either key or as plain texts."""
    text = F.concat(F.lit('{"summary": "'), "p_type", F.lit('", "entity_checks": [{"entity": " '), "p_name", F.lit('x ", "attributed_molecules": [], "recommended_top_molecules": [{"canonical_molecule": "'), "p_name", F.lit('"}, {"name": "'), "p_brand", F.lit('"}, "plain", {"other": 1}]}, {"entity": ""}]}'))
    a = W.spread(W.table(spark, d, "part"), "p_partkey").select("p_partkey", N.med_check_answer(text).alias("a"))
    return a.select("p_partkey", "a.whats_changed", F.array_join(F.col("a.checks")[0]["recommended_top_molecules"], "|").alias("molecules"), F.col("a.checks")[0]["entity"].alias("entity"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 5 THEN '' WHEN 1 THEN 'in ' || p_brand WHEN 4 THEN p_name ELSE p_brand END AS medicine, CASE p_partkey % 6 WHEN 2 THEN 'salvaged' WHEN 5 THEN 'no medicine today' WHEN 3 THEN '' WHEN 4 THEN '' ELSE 'why' END AS explanation, p_partkey % 6 NOT IN (2, 5) AS parsed, CASE WHEN p_partkey % 6 = 0 THEN CAST(0.5 AS DOUBLE) END AS confidence_score FROM part""")
def contract_prescriptions(spark, d):
    """The prescribing contracts: objects, wrapped recommendations, plain names, a bare list, broken JSON and prose."""
    b = F.col("p_brand")
    shapes = [
        F.concat(F.lit('{"medications": [{"brand_name": "'), b, F.lit('", "dose": 5}], "explanation": "why", "confidence_score": 0.5}')),
        F.concat(F.lit('{"medications": [], "recommended_medications": [{"medication_master_item": {"brand_name": "in '), b, F.lit('"}, "priority": 1}], "explanation": "why"}')),
        F.concat(F.lit('{"medications": [{"brand_name": " '), b, F.lit(' ", }], "explanation": "salvaged"')),
        F.concat(F.lit('{"medications": " '), b, F.lit(' "}')),
        F.concat(F.lit('```json\n["'), F.col("p_name"), F.lit('"]\n```')),
        F.lit("no medicine today"),
    ]
    text = F.element_at(F.array(*shapes), (F.col("p_partkey") % 6 + 1).cast("int"))
    a = W.spread(W.table(spark, d, "part"), "p_partkey").select("p_partkey", N.prescription_answer(text).alias("a"))
    return a.select("p_partkey", F.coalesce(F.get("a.medications", F.lit(0))["brand_name"], F.lit("")).alias("medicine"), "a.explanation", "a.parsed", "a.confidence_score")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'q ' || p_name WHEN 1 THEN 'Pharmacotherapy and clinical dosing indication for ' || p_brand || ' with ' || p_name || ', b.' ELSE 'Pharmacotherapy for general clinical presentation.' END AS query, CASE p_partkey % 3 WHEN 0 THEN 'k' WHEN 1 THEN array_to_string(list_sort([p_brand, p_name, 'b']), '|') ELSE 'Medication' END AS keywords FROM part""")
def contract_search_queries(spark, d):
    """Search queries from an answer, or made from the terms where the answer can't be read."""
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit('```json\n{"vector_semantic_queries": "q '), "p_name", F.lit('", "bm25_keywords": [" k ", ""]}\n```'))).otherwise("none")
    none = F.array().cast("array<string>")
    s, x = F.when(k < 2, F.array(F.col("p_name"), F.lit("b"), F.lit(""))).otherwise(none), F.when(k < 2, F.array("p_brand")).otherwise(none)
    a = W.spread(W.table(spark, d, "part"), "p_partkey").select("p_partkey", N.search_queries_answer(text, s, x).alias("a"))
    return a.select("p_partkey", F.col("a.vector_semantic_queries")[0].alias("query"), F.array_join("a.bm25_keywords", "|").alias("keywords"))


@query("""SELECT p_partkey, 'Clinical dosing indication for management of ' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'clinical condition' END || ' with ' || p_name || ', b.' AS query, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|' ELSE '' END || p_name || '|b|Pharmacotherapy' AS keywords FROM part""")
def l3_search_queries_offline(spark, d):
    """Search queries asked of the offline stand-in."""
    from .workflows import offline_answer

    rows = W.table(spark, d, "part").select("p_partkey", F.array(F.col("p_name"), F.lit("b")).alias("symptoms"), F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand")).alias("diagnoses"))
    found = C.search_queries(rows, ["p_partkey"], offline_answer)
    return found.select("p_partkey", F.col("vector_semantic_queries")[0].alias("query"), F.array_join("bm25_keywords", "|").alias("keywords"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'step2_fill_gap_prescription' WHEN 1 THEN 'step1_psychiatrist_prescription' WHEN 2 THEN 'triage_symptom_changes' WHEN 3 THEN 'deprescribing_review' WHEN 4 THEN 'medication_search_queries' ELSE 'llm_generation' END AS name FROM events""")
def l5_call_names(spark, d):
    phrases = ("Deprescribe? STEP 2: Fill clinical gaps", "you are a Senior Consultant Indian Psychiatrist", "the Clinical Context of deprescribing", "Deprescribing", "PATIENT CLINICAL PRESENTATION", "hello")
    prompt = F.element_at(F.array(*map(F.lit, phrases)), (F.col("event_id") % 6 + 1).cast("int"))
    return W.table(spark, d, "events").select("event_id", N.call_name(prompt).alias("name"))


@query("""SELECT n_nationkey AS case_id, e AS entity, CASE WHEN e = 'a' THEN 'X' WHEN n_nationkey % 3 = 0 THEN 'P, Q' ELSE '' END AS molecules, CASE WHEN n_nationkey % 3 = 0 THEN 'said' WHEN n_nationkey % 3 = 1 THEN 'Assigned candidate formulary medications for 1 gap entities: b.' ELSE 'All clinical entities have existing candidate medication matches; no medications' END AS report
FROM nation, (SELECT unnest(['a', 'b']) AS e) WHERE n_nationkey % 3 < 2 OR e = 'a'""".replace("no medications'", "no missing medications required from formulary.'"))
def q9_med_check_step(spark, d):
    """The second step: gaps of the matrix filled from an answer, by encounter; encounters without gaps say so."""
    k = F.col("n_nationkey") % 3
    n = W.table(spark, d, "nation").withColumnRenamed("n_nationkey", "case_id")
    k = F.col("case_id") % 3
    none = F.array().cast("array<string>")
    matrix = n.select("case_id", F.lit("a").alias("entity"), F.array(F.lit("X")).alias("molecules")).unionByName(n.where(k < 2).select("case_id", F.lit("b").alias("entity"), none.alias("molecules")))
    checks = F.lit('{"whats_changed": "said", "entity_medication_check": [{"entity": "B ", "attributed_molecules": ["P"], "recommended_top_molecules": [{"name": "Q"}]}, {"entity": "a", "attributed_molecules": ["x"]}]}')
    answers = n.select("case_id", F.when(k == 0, checks).alias("answer"))
    filled, report = C.med_check_step(matrix, answers, ["case_id"])
    return filled.join(report, "case_id").select("case_id", "entity", F.array_join("molecules", ", ").alias("molecules"), F.col("whats_changed").alias("report"))


@query(f"""WITH {_MASTER_SQL}, k AS (SELECT lower(brand_name) AS b, arg_min(canonical_molecule, ordinal) AS molecule FROM master GROUP BY 1) SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'Own + Mix' ELSE coalesce(k.molecule, p_brand || CASE WHEN p_partkey % 3 = 1 THEN ' 50 mg' ELSE '' END) END AS molecule, p_partkey % 3 = 2 AS is_fdc, 'e' AS explanation FROM part LEFT JOIN k ON lower(p_brand) = k.b""")
def q9_prescribe_step(spark, d):
    """The third step: prescribed medicines filled in from the master, by brand with or without a strength."""
    k = F.col("p_partkey") % 3
    med = F.when(k == 2, F.lit('{"brand_name": "Mix", "canonical_molecule": "Own + Mix"}')).when(k == 1, F.concat(F.lit('{"brand_name": "'), "p_brand", F.lit(' 50 mg", "is_fdc": "no"}'))).otherwise(F.concat(F.lit('"'), "p_brand", F.lit('"')))
    answers = W.table(spark, d, "part").select("p_partkey", F.concat(F.lit('{"explanation": "e", "medications": ['), med, F.lit("]}")).alias("answer"))
    # without a brand in the master the name stands for the molecule, with its strength
    rows = C.prescribe_step(answers, ["p_partkey"], _master(spark, d), ["canonical_molecule"])
    return rows.select("p_partkey", F.col("canonical_molecule").alias("molecule"), "is_fdc", "explanation")


@query(f"""WITH {W.VISITS_SQL}, r AS (SELECT c_custkey AS request_id, c_custkey % 4 <> 3 AS ok FROM customer), h AS (SELECT case_no AS request_id, count(*) AS n FROM visits GROUP BY 1) SELECT request_id, CASE WHEN NOT ok THEN 'At least 1 symptom and 1 diagnosis is required.' END AS error, coalesce(n, 0) AS past_count, CAST(CASE WHEN request_id % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS similar_count, CASE WHEN ok THEN 0 END AS n_medications FROM r LEFT JOIN h USING (request_id)""")
def q10_prescribe_v1(spark, d):
    """The one-step form: requests refused without a symptom and a diagnosis, the others answered with their past and similar cases."""
    from .workflows import offline_answer

    k = F.col("c_custkey")
    some, none = F.array(F.lit("x")), F.array(F.lit(" "))
    requests = W.table(spark, d, "customer").select(k.alias("request_id"), some.alias("symptoms"), F.when(k % 4 != 3, some).otherwise(none).alias("diagnoses"))
    history = W.visits(spark, d).select(F.col("case_no").alias("request_id"), F.col("visit_reason").alias("text"))
    similar = requests.where("request_id % 2 = 0").select("request_id", F.explode(F.array(F.lit("s1"), F.lit("s2"))).alias("text"))
    rows = C.prescribe_v1(requests, history, similar, offline_answer)
    return rows.select("request_id", "error", "past_count", "similar_count", F.when(F.col("medications").isNotNull(), F.size("medications")).alias("n_medications"))


@query("""SELECT conv_id AS case_no, CAST(DATE '2024-01-05' AS VARCHAR) AS visit_date, 'user-' || conv_id AS name, substr(text, 1, 60) AS symptom, 'Unspecified diagnosis' AS diagnosis, 64 AS dimensions FROM conversations WHERE turn = 0 ORDER BY conv_id LIMIT 20""")
def q11_training_cases(spark, d):
    """The first training records as case rows with vectors."""
    from ..functions.udfs import embedder

    records = W.table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), F.lit("2024-01-05 10:00:00").alias("created_at"), F.concat(F.lit("user-"), "conv_id").alias("patient_id"), F.col("text").alias("clinical_note"), F.lit(None).cast("string").alias("suspected_condition"))
    rows = C.training_cases(records, embedder(), 20)
    s, x = F.col("symptoms")[0], F.col("diagnosis")[0]
    return rows.select("case_no", "visit_date", "name", s["text"].alias("symptom"), x["text"].alias("diagnosis"), F.size(s["embedding"]).alias("dimensions"))


@query(f"""WITH {W.VISITS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY visit_date, line) AS n FROM (SELECT case_no, visit_date, CAST(visit_date AS VARCHAR) || ' (' || CASE WHEN y > 0 THEN y || ' year' || CASE WHEN y > 1 THEN 's' ELSE '' END || ' ago' END || '); complaints: ' || visit_reason || '; diagnoses: none; medicines: m' AS line FROM (SELECT *, date_diff('day', visit_date, DATE '2015-01-01') // 365 AS y FROM visits)))
SELECT case_no, string_agg(n || '. ' || line, chr(10) ORDER BY n) AS history FROM v GROUP BY 1""")
def t22_history_text(spark, d):
    """Past visits as numbered lines of a prompt."""
    rows = W.visits(spark, d).select("case_no", "visit_date", F.array("visit_reason").alias("symptoms"), F.array().cast("array<string>").alias("diagnoses"), F.array(F.lit("m")).alias("medications"))
    return C.history_text(rows, ["case_no"], F.lit("2015-01-01").cast("date"))
