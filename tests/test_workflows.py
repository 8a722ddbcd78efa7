import json

from pyspark.sql import functions as F

from cohortspark.operators import ontology
from cohortspark.plans import workflows as P


def test_migration(spark):
    day = lambda df: df.withColumn("visit_date", F.to_date("visit_date"))
    visits = day(spark.createDataFrame([(100, "2025-05-29", "Follow-up Visit"), (100, "2025-04-01", "New")], "case_no long, visit_date string, visit_reason string"))
    patients = spark.createDataFrame([(100, "f", 30.44)], "case_no long, gender string, age double")
    complaints = day(spark.createDataFrame([(100, "2025-05-29", "● Sadness of Mood\n● Anxiety\n● no fever")], "case_no long, visit_date string, chief_complaints string"))
    dx = day(spark.createDataFrame([(100, "2025-05-29", "Panic disorder"), (100, "2025-05-29", "Major depressive disorder")], "case_no long, visit_date string, diagnosis string"))
    rx = day(spark.createDataFrame([(100, "2025-05-29", "ZOLAVIL"), (100, "2025-05-29", "ESCIREN")], "case_no long, visit_date string, medicine string"))
    terms = spark.createDataFrame([("HP:0000739", "Anxiety", ["Anxiousness"]), ("HP:0001945", "Fever", [])], "id string, label string, synonyms array<string>").withColumns({"definition": F.lit(""), "alt_ids": F.array().cast("array<string>")})
    entries = ontology.search_entries(terms)
    resolver = P.ontology_resolver(entries, ontology.token_postings(entries), "strict")
    master = spark.createDataFrame([("ZOLAVIL", "Etizolam", 0)], "brand_name string, canonical_molecule string, ordinal int")
    sources = {"visits": visits, "patients": patients, "complaints": complaints, "diagnoses": dx, "prescriptions": rx}
    cases = P.migrate(sources, None, {"symptoms": resolver, "diagnosis": resolver, "medications": P.medicine_resolver(master, ["brand_name", "canonical_molecule"])})
    row = cases.where("is_latest").first()
    assert [s.term for s in row.symptoms] == ["Sadness of Mood", "Anxiety", "no fever"] and [s.is_negated for s in row.symptoms] == [False, False, True]
    assert row.symptoms[1].curie == "HP:0000739" and row.symptoms[2].curie == "HP:0001945" and row.symptoms[0].curie is None
    assert len(row.diagnosis) == 2 and [m.canonical_molecule for m in row.medications] == [None, "Etizolam"] and cases.count() == 2
    again = P.migrate({**sources, "visits": visits.withColumn("visit_reason", F.lit("x"))}, cases, {"symptoms": resolver, "diagnosis": resolver, "medications": P.medicine_resolver(master, ["brand_name", "canonical_molecule"])})
    assert again.count() == 2 and {r.visit_reason for r in again.collect()} == {"x"}


def test_context_and_checks(spark):
    rows = spark.createDataFrame(
        [(1, "2024-01-01", ["insomnia"], ["mdd"], ["a"]), (1, "2024-02-01", ["insomnia improved", "tremor"], [], ["b", "a"]), (1, "2024-03-01", ["denies tremor"], ["mdd"], [])],
        "case_no int, visit_date string, symptoms array<string>, diagnoses array<string>, medications array<string>",
    )
    first, second, third = P.encounter_context(rows).orderBy("visit_date").collect()
    assert first.new_symptoms == ["insomnia"] and second.decreased_symptoms == ["insomnia improved"] and second.new_symptoms == ["tremor"] and second.stop_diagnoses == ["mdd"]
    assert third.stop_symptoms == ["tremor"] and third.historical_prescription == ["a", "b"] and third.latest_documented_prescription == ["b", "a"]
    assert "Decreased symptoms: insomnia improved" in second.clinical_summary
    matrix = spark.createDataFrame([("Insomnia", ["X"]), ("Tremor", [])], "entity string, molecules array<string>")
    answer = "```json\n" + json.dumps({"entity_medication_check": [{"entity": "tremor", "attributed_molecules": ["P"], "recommended_top_molecules": ["Q"]}, {"entity": "insomnia", "attributed_molecules": ["x", "Y"]}]}) + "\n```"
    checked = {r.entity: r.molecules for r in P.check_medications(matrix, spark.createDataFrame([(answer,), (None,)], "answer string")).collect()}
    assert checked == {"Insomnia": ["X", "Y"], "Tremor": ["P", "Q"]}
    assert {r.row for r in P.matrix_text(matrix).collect()} == {"| Insomnia | X |", "| Tremor | none found |"}
    log = P.call_log(spark.createDataFrame([("triage", "text " * 10)], "call_name string, prompt string"), "x-pro").first()
    assert log.cost > 0 and json.loads(log.answer.strip("`").removeprefix("json"))["medications"] == []


def test_report(spark):
    med = "struct<brand_name:string,canonical_molecule:string,constituent_strengths_mg:map<string,double>>"
    rows = [(332, [("A", "M1", None), ("B", "M2 + M3", None)], ([("A2", "m1", None), ("B", "M2 + M3", None)],), "46-65", "Male", "Follow-up", "2"), (333, [], (None,), "0-5", "Female", "New Consultation", "0")]
    records = spark.createDataFrame(rows, f"caseNo int, expectedMeds array<{med}>, res struct<medications:array<{med}>>, age_group string, gender string, consultation_type string, count_bucket string")
    cases, summary, confusion = P.accuracy_report(records, "fdc_broken")
    got = {r.caseNo: (r.matched_count, r.accuracy) for r in cases.collect()}
    assert got == {332: (3, 100.0), 333: (0, 100.0)}
    assert summary.where("dimension = 'overall'").first().accuracy == 100.0 and confusion.first().tp == 3
    brand = P.accuracy_report(records, "brand")[0].where("caseNo = 332").first()
    assert brand.accuracy == 50.0


def test_only_the_entity_with_a_past_is_maintained(spark):
    from pyspark.sql import functions as F

    from cohortspark.plans import composites, entity_queries

    names = [(1, "hot bolt"), (2, "blue ring"), (3, "old plate"), (4, "cold plate"), (5, "hot gear"), (6, "hot plate")]
    named = entity_queries._stated(spark.createDataFrame(names, "p_partkey long, p_name string"))
    told = entity_queries._told(named)
    status = {r.query_id: r.delta_status for r in composites.stamped(named, told, ["encounter"]).collect()}
    assert status == {1: "stop", 2: "decreased", 3: "maintained", 4: "new", 6: "increased"}
    # one that shares a word with its own past isn't new
    shared = composites.stamped(named.where("query_id = 4").withColumn("encounter", F.lit(2)), told, ["encounter"])
    assert [r.delta_status for r in shared.collect()] == ["maintained"]
