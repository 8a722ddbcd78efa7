"""Requests, readers, resolution and the steps of prescribing on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from cohortspark import __main__ as command
from cohortspark import requests as Q
from cohortspark.functions import text as X
from cohortspark.functions import udfs
from cohortspark.functions import vectors as V
from cohortspark.operators import assessment as A
from cohortspark.operators import encounters, evaluation, ontology, pairs, resolution, taxonomy, upsert
from cohortspark.plans import composites as C
from cohortspark.sources import readers


def test_requests_merge_aliases():
    r = Q.rank_request({"type": "chiefComplain", "query": " insomnia ", "age": 30, "gender": "f", "patient_info": {"age": 70, "gender": "m"}, "params": {"w_lca": 1.0, "w_age": 3}})
    assert (r.entity_type, r.query, r.age, r.gender, r.weights.w_lca, r.weights.w_vector, r.k) == ("symptom", "insomnia", 30.0, "f", 1.0, 0.5, 5)
    assert Q.rank_request({"type": "diagnosis", "query": "x", "patient_info": {"age": 70}}).age == 70.0
    assert Q.rank_request({"type": "diagnosis", "query": "x", "patient_age": 1, "age": 2}).age == 1.0
    for bad in ({"type": "x", "query": "y"}, {"type": "symptom", "query": " "}, {"type": "symptom", "query": "y", "k": 51}, {"type": "symptom", "query": "y", "weights": {"min_similarity": 2}}):
        with pytest.raises(ValueError):
            Q.rank_request(bad)
    c = Q.case_request({"case": {"caseNo": 5, "symptom": "a", "diagnosis": ["b", " "], "patientInfo": {"age": 3}}, "top_k": 7, "top_k_per_entity": 2})
    assert (c["symptoms"], c["diagnoses"], c["top_k"], c["age"]) == (["a"], ["b"], 7, 3)
    with pytest.raises(ValueError):
        Q.Weights(0, 0, 0, 0)
    assert sum(Q.Weights().as_dict().values()) == 1.0


def test_json_arrays_are_arrays(spark, tmp_path):
    one, many, broken = tmp_path / "one.json", tmp_path / "many.json", tmp_path / "broken.json"
    one.write_text('{"brand_name": "A"}')
    many.write_text(' \n[{"brand_name": "A"}, {"brand_name": "B"}]')
    broken.write_text("[{]")
    assert readers.medicine_master(spark, str(many)).count() == 2
    with pytest.raises(ValueError):
        readers.medicine_master(spark, str(one))
    assert readers.medicine_master(spark, str(one), strict=False).count() == 0
    with pytest.raises(Exception):
        readers.medicine_master(spark, str(broken)).collect()
    with pytest.raises(Exception):
        readers.medicine_master(spark, str(tmp_path / "none.json"))
    assert readers.medicine_master(spark, str(tmp_path / "none.json"), strict=False).count() == 0


def test_batch_cases_and_result_files(spark, tmp_path):
    (tmp_path / "tmp").mkdir()
    for name in ("prescribe_pipeline_1.json", "prescribe_pipeline_2.json"):
        (tmp_path / "tmp" / name).write_text(json.dumps([{"req": {"case": {"caseNo": 3, "visitType": "follow-up", "patientInfo": {"age": 4, "gender": "f"}, "symptoms": ["a"], "diagnosis": []}}, "expectedMeds": [{"brand_name": "Z"}]}]))
    folders = [str(tmp_path / "nowhere"), str(tmp_path / "tmp")]
    assert readers.result_path(spark, "prescribe_pipeline_1.json", folders).endswith("tmp/prescribe_pipeline_1.json")
    newest = readers.result_path(spark, None, folders)
    row = readers.batch_cases(spark, newest).first()
    assert (row.case_no, row.visit_type, row.age, row.symptoms, row.expected[0].brand_name) == (3, "follow-up", 4.0, ["a"], "Z")
    for given, where in (("no.json", folders), (None, folders[:1])):
        with pytest.raises(FileNotFoundError):
            readers.result_path(spark, given, where)
    spark.range(1).write.parquet(str(tmp_path / "t"))
    assert {r.store: r.ok for r in readers.ping(spark, {"t": str(tmp_path / "t"), "u": str(tmp_path / "u")}).collect()} == {"t": True, "u": False}


def test_jdbc_options(spark, monkeypatch):
    seen = {}

    class Reader:
        def format(self, name):
            seen["format"] = name
            return self

        def options(self, **kw):
            seen.update(kw)
            return self

        def load(self):
            return "loaded"

    class Session:
        read = Reader()

    assert readers.jdbc_table(Session(), "jdbc:x", "visits", ("id", 0, 100, 8), 500, user="u") == "loaded"
    assert seen == {"format": "jdbc", "url": "jdbc:x", "dbtable": "visits", "fetchsize": "500", "user": "u", "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "8"}


def test_parents_by_alternative_ids(spark):
    terms = spark.createDataFrame([("A", [], ["A0"], False), ("B", ["A0"], [], False), ("C", ["B", "gone"], ["B"], False), ("D", ["C"], [], False), ("gone", [], [], True)], "id string, parents array<string>, alt_ids array<string>, is_obsolete boolean")
    edges = taxonomy.edges_of(terms)
    assert {tuple(r) for r in edges.collect()} == {("B", "A"), ("C", "B"), ("D", "C")}
    closure = taxonomy.ancestor_closure(terms.where("not is_obsolete").select(F.col("id").alias("code")), edges)
    asked = taxonomy.canonicalized(spark.createDataFrame([("A0", "D"), ("B", "D")], "a string, b string"), "a", terms)
    assert {(r.a, round(r.wu_palmer, 4)) for r in taxonomy.wu_palmer(asked, closure, 0).collect()} == {("A", 0.4), ("B", 0.6667)}


def test_last_row_of_a_key_is_settled_by_its_values(spark):
    rows = [(1, "b", 2), (1, "a", 3), (1, "b", 1)]
    for order in (rows, rows[::-1]):
        assert tuple(upsert.last_per_key(spark.createDataFrame(order, "k int, x string, y int").repartition(3), ["k"]).first()) == (1, "b", 2)


def test_set_similarity_of_entities(spark):
    """Idf weights, missing codes and vectors, and sets without anything alike."""
    e = lambda term, code=None, v=None: (term, code, v)
    kind = "array<struct<term:string,code:string,embedding:array<double>>>"
    asked = spark.createDataFrame([(1, [e("Low mood", "HP:1", [1.0, 0.0]), e("insomnia", None, [0.0, 1.0]), e("insomnia ")])], f"q int, e {kind}")
    cases = spark.createDataFrame([(1, [e("low mood ", None, None)]), (2, [e("x", "HP:1"), e("y", None, [0.0, 2.0])]), (3, [e("z", None, [-1.0, 0.0])]), (4, []), (5, [e("w", None, [0.6, 0.8])])], f"case_id int, e {kind}")
    q, c = pairs.entities(asked, ["q"], "e"), pairs.entities(cases, ["case_id"], "e")
    assert q.count() == 2
    got = {r.case_id: round(r.set_similarity, 4) for r in pairs.set_similarities(q, c, ["q"], ["case_id"]).collect()}
    # case 5: cosines 0.6 and 0.8, sharpened from 0.3
    a, b = (0.6 - 0.3) / 0.7, (0.8 - 0.3) / 0.7
    assert got == {1: 0.75, 2: 1.0, 5: round(0.5 * (a + b) / 2 + 0.5 * b, 4)}
    import math

    df = spark.createDataFrame([("code:HP:1", 99)], "key string, df int")
    wq = [math.log(1001 / 100) + 1, math.log(1001 / 2) + 1]
    got = {r.case_id: round(r.set_similarity, 4) for r in pairs.set_similarities(q, c, ["q"], ["case_id"], document_frequency=df, beta=0.25).collect()}
    assert got[1] == round(0.75 * wq[0] / sum(wq) + 0.25, 4)


def test_blocks_of_queries_give_the_same_pairs(spark, monkeypatch):
    from cohortspark.operators import cosine_join

    rows = [(i, f"t{i % 7}", f"c{i % 5}" if i % 2 else None, [float(i % 3), 1.0]) for i in range(40)]
    frame = spark.createDataFrame(rows, "case_id int, term string, code string, embedding array<double>")
    asked = frame.where("case_id < 20").withColumnRenamed("case_id", "q")
    shown = lambda: sorted((r.q, r.case_id, r.lca, round(r.cos, 9)) for r in pairs.evidence(asked, frame, ["q"], ["case_id"]).collect())
    want = shown()
    monkeypatch.setattr(cosine_join.cosine_pairs, "__defaults__", (*cosine_join.cosine_pairs.__defaults__[:-1], 4))
    assert shown() == want and want


@pytest.fixture(scope="module")
def hpo(spark):
    terms = spark.createDataFrame([("HP:0000739", "Anxiety", ["Anxiousness"]), ("HP:0001945", "Fever", []), ("HP:0004396", "Poor appetite", ["Loss of appetite"])], "id string, label string, synonyms array<string>").withColumns({"definition": F.lit(""), "alt_ids": F.array().cast("array<string>")})
    entries = ontology.search_entries(terms)
    return entries, ontology.token_postings(entries)


def test_assertions(spark):
    rows = spark.createDataFrame([("denies fever",), ("loss of appetite",), ("history of anxiety",), ("? anxiety",), ("mother had anxiety",), ("anxiety",), ("fever resolved",)], "term string")
    got = {r.term: (r.assertion_status, r.search_target, r.is_phenotype) for r in resolution.asserted(rows).collect()}
    assert got == {
        "denies fever": ("negated", "fever", False), "loss of appetite": ("affirmed", "loss of appetite", True), "history of anxiety": ("historical", "anxiety", False), "? anxiety": ("uncertain", "anxiety", False),
        "mother had anxiety": ("family", "anxiety", False), "anxiety": ("affirmed", "anxiety", True), "fever resolved": ("negated", "fever", False),
    }


def test_resolution(spark, hpo):
    terms = spark.createDataFrame([("denies fever",), ("loss of appetite",), ("anxiousness",), ("purple",), (" ",)], "term string")
    got = {r.term: (r.hpo_id, r.is_negated) for r in resolution.resolved(terms, {"hpo": hpo}).collect()}
    assert got == {"denies fever": ("HP:0001945", True), "loss of appetite": ("HP:0004396", False), "anxiousness": ("HP:0000739", False), "purple": (None, False)}
    assert {r.term for r in resolution.assertion_search(terms, *hpo, k=1, filter_negated=True).collect()} == {"loss of appetite", "anxiousness"}
    both = resolution.matched(terms, {"a": hpo, "b": hpo}, 2)
    assert {r.ontology for r in both.collect()} == {"a", "b"}
    notes = spark.createDataFrame([(1, "● Anxiety\n* no fever\n\n x"), (2, None), (3, "")], "i int, note string")
    rows = resolution.processed_notes(notes, ["i"], *hpo, udfs.embedder(4)).orderBy("pos").collect()
    assert [(r.segment, r.is_pheno, r.hpo_code, r.embedding is not None) for r in rows] == [("Anxiety", True, 739, True), ("no fever", False, None, False), ("x", False, None, False)]
    given = spark.createDataFrame([("anxiety", None, None), ("fever", 7, None), ("fever", None, "HP:0000009"), (None, None, None)], "term string, code long, curie string")
    assert sorted((r.term or "", r.code or 0, r.curie or "") for r in resolution.filled_codes(given, *hpo, "HP").collect()) == [("", 0, ""), ("anxiety", 739, "HP:0000739"), ("fever", 7, "HP:0000007"), ("fever", 9, "HP:0000009")]


def test_decorated_cases(spark, hpo):
    cases = spark.createDataFrame([(1, ["no fever", "Anxiety", "Anxiety", " "], ["- Fever ."]), (2, None, [])], "i int, symptoms array<string>, diagnosis array<string>")
    a, b = resolution.decorate_cases(cases, ["i"], hpo, hpo, udfs.embedder(4)).orderBy("i").collect()
    assert [(s.term, s.code, s.is_negated) for s in a.symptoms] == [("no fever", "HP:0001945", True), ("Anxiety", "HP:0000739", False), ("Anxiety", "HP:0000739", False)]
    assert a.diagnosis[0].term == "Fever" and a.diagnosis[0].code == "HP:0001945" and len(a.diagnosis[0].embedding) == 4
    assert b.symptoms == [] and b.diagnosis == []


ENCOUNTER = "i int, symptoms array<string>, diagnoses array<string>, past_symptoms array<string>, past_diagnoses array<string>, age double, gender string, visit_type string, answer string"


def test_steps_without_and_with_an_answer(spark):
    answer = json.dumps(
        {
            "patient_condition": "better", "symptom_notes": "sleep is better", "whats_changed": "", "historical_prescription": ["Old"],
            "triaged_items": [{"raw_text": "Insomnia improved", "category": "symptom", "canonical_entity": "Insomnia", "status": "better"}, {"complaint": "informant: wife", "category": "nonsense"}],
            "deprescribing_recommendations": [{"medicine": "Zolpidem", "action": "stop", "target_symptom": "insomnia"}], "patient_reported_current_use": ["Escitalopram"],
        }
    )
    rows = [
        (1, ["insomnia improved", "Informant: wife", "denies tremor", "new rash", "stopped taking Lorazepam 1mg"], ["MDD"], ["insomnia", "hand tremor"], ["mdd", "gad"], 41.5, "F", "Follow-up", answer),
        (2, ["insomnia improved", "denies tremor", "new rash"], ["MDD"], ["insomnia", "hand tremor"], ["mdd", "gad"], 41.0, None, "new", "no json here"),
        (3, [], None, [], [], None, "", None, answer),
        (4, ["low mood", "denies pain"], ["MDD"], None, None, 5.0, "m", "follow_up", None),
    ]
    got = {r.i: r for r in C.deprescribe_step(spark.createDataFrame(rows, ENCOUNTER), "answer").collect()}
    one, two, three, four = (got[i] for i in (1, 2, 3, 4))
    assert one.used_llm and one.decreased_symptoms == ["insomnia"] and one.stop_symptoms == ["hand tremor", "stopped taking Lorazepam 1mg"] and one.symptom_notes == "sleep is better"
    assert one.triaged_items[1].category == "non_symptom" and "new rash" in one.new_symptoms and one.stop_diagnoses == ["gad"]
    assert one.patient_reported_current_use == ["Escitalopram"] and one.actual_discontinuation[-1] == "Zolpidem"
    assert one.whats_changed == "Medication actions recommended: stop Zolpidem for insomnia."
    assert one.clinical_summary.splitlines()[:4] == ["case type: follow up visit", "patient age: 41.5 yrs", "patient gender: f", "informant: wife"]
    assert "- insomnia improved (improved)" in one.clinical_summary and one.triage_delta[0].changed is False and one.triage_delta[0].llm_status == "improved"
    assert not two.used_llm and two.decreased_symptoms == ["insomnia improved"] and two.stop_symptoms == ["hand tremor"] and two.new_symptoms == ["new rash"] and two.deprescribing_recommendations == []
    assert two.symptom_notes == "insomnia improved: improved, changed from insomnia | tremor: resolved / denied | new rash: new symptom"
    assert three.patient_condition == "No chief complaints recorded for current visit." and three.triaged_items == []
    assert four.new_symptoms == ["low mood"] and four.stop_symptoms == [] and four.patient_condition == "Initial baseline consultation" and four.new_diagnoses == ["MDD"]


def test_med_check_without_keys(spark):
    matrix = spark.createDataFrame([("Insomnia", ["X"]), ("Tremor", [])], "entity string, molecules array<string>")
    answers = spark.createDataFrame([("no json",)], "answer string")
    filled, report = C.med_check_step(matrix, answers)
    assert {r.entity: r.molecules for r in filled.collect()} == {"Insomnia": ["X"], "Tremor": []}
    assert report.first().whats_changed == "Assigned candidate formulary medications for 1 gap entities: Tremor." and C.gaps(matrix).count() == 1


def test_prompts(spark):
    rows = spark.createDataFrame([(1, "case type: x"), (2, "y")], "i int, clinical_summary string")
    matrix = spark.createDataFrame([(1, "b", []), (1, "a", ["M", "N"])], "i int, entity string, molecules array<string>")
    got = {r.i: r.prompt for r in C.prescription_prompts(rows, matrix, ["i"]).collect()}
    assert got[1] == "case type: x\n\n| entity | molecules |\n| --- | --- |\n| a | M, N |\n| b | none found |" and got[2].startswith("y\n\n")
    assert spark.range(1).select(X.run_id(F.lit(7), F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("r")).first().r.startswith("case_7_20240102_030405_")


def test_sizes_of_a_split(spark):
    records = spark.createDataFrame([(1, "r", ("p" * 50, "e"))], "caseNo int, runId string, res struct<prompt:string,explanation:string>")
    light, audit = evaluation.without_prompts(records)
    row = evaluation.split_sizes(records, light, audit).first()
    assert row.bytes_before > row.bytes_light > 0 and row.saved_percent > 30 and light.first().res.explanation == "e"


def test_runs_with_empty_answers(spark):
    med = "array<struct<canonical_molecule:string,dosage_group_id:string>>"
    old = spark.createDataFrame([(1, [("A", "g")], [("a", "g")]), (2, [], [("B", None)]), (3, [], []), (4, [("A", None)], None)], f"case_no int, expected {med}, medications {med}")
    new = spark.createDataFrame([(1, []), (2, []), (3, []), (4, [])], f"case_no int, medications {med}")
    got = {r.case_no: (r.recall_old, r.recall_new, r.group_recall_old, r.old_extra) for r in evaluation.compare_runs(old, new).collect()}
    assert got == {1: (1.0, 0.0, 1.0, 0), 2: (0.0, 1.0, 1.0, 1), 3: (1.0, 1.0, 1.0, 0)}


def test_histories_equal_a_loop(spark):
    import random

    rng = random.Random(9)
    rows = [(i, rng.randint(0, 3), rng.randint(0, 50), [rng.choice("abcde") for _ in range(rng.randint(0, 3))] if rng.random() < 0.9 else None) for i in range(80)]
    frame = spark.createDataFrame(rows, "i int, case_no int, t int, x array<string>")
    got = {r.i: r.past for r in encounters.histories(frame, {"past": "x"}, ["t", "i"]).collect()}
    for i, case, t, _ in rows:
        before = sorted((r for r in rows if r[1] == case and (r[2], r[0]) < (t, i)), key=lambda r: (r[2], r[0]))
        assert got[i] == list(dict.fromkeys(v for r in before for v in r[3] or []))
    one = encounters.with_history(frame.select("i", "case_no", "t", F.get("x", F.lit(0)).alias("v")), "v", "past", ["t", "i"])
    assert one.columns == ["i", "case_no", "t", "v", "past"]


def test_pooling_and_units(spark):
    row = spark.range(1).select(V.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), V.unit(F.array(F.lit(0.0))).alias("z"), V.mean_pooled(F.array(F.array(F.lit(1.0)), F.array(F.lit(3.0))), F.array(F.lit(1), F.lit(1))).alias("m")).first()
    assert row.u == [0.6, 0.8] and row.z == [0.0] and row.m == [2.0]


def test_marks_of_awkward_complaints(spark):
    rows = spark.createDataFrame([(None, None), ([], []), ([None, "", " x "], [None, " "])], "symptoms array<string>, past_symptoms array<string>")
    assert [len(r.marks) for r in A.keyword_marks(rows).collect()] == [0, 0, 1]


def test_command_line(spark, tmp_path, capsys):
    obo = tmp_path / "x.obo"
    obo.write_text("format-version: 1.2\n\n[Term]\nid: HP:0000739\nname: Anxiety\n\n[Term]\nid: MONDO:0000001\nname: Flu\n")
    assert command.main(["search-hpo", "anxiety", "--obo", str(obo)]) == 0
    assert json.loads(capsys.readouterr().out)["id"] == "HP:0000739"
    assert command.main(["search-mondo", "denies flu", "--obo", str(obo), "--filter-negated"]) == 1
    assert command.main(["embed", "anxiety"]) == 0 and len(json.loads(capsys.readouterr().out)) == 64
    spark.createDataFrame([(2, "2024-01-01 00:00:00", "p", "note", None)], "id int, created_at string, patient_id string, clinical_note string, suspected_condition string").write.parquet(str(tmp_path / "r"))
    assert command.main(["run-demo", str(tmp_path / "r"), str(tmp_path / "t")]) == 0 and json.loads(capsys.readouterr().out) == {"cases": 1}
    assert command.main(["check-health", f"t={tmp_path / 't'}"]) == 0 and command.main(["check-health", f"u={tmp_path / 'u'}"]) == 1
