import pytest
from pyspark.sql import functions as F

from cohortspark.operators import delta, encounters, evaluation, medicines, ontology, ranking, similarity, taxonomy, upsert
from cohortspark.sources import readers

OBO = """format-version: 1.2

[Term]
id: HP:0000001
name: All

[Term]
id: HP:0000002
name: Sleep disturbance
synonym: "Disturbed sleep" EXACT []
def: "An abnormality of sleep." [x]
is_a: HP:0000001 ! All

[Term]
id: HP:0000003
name: Abnormal sleep quality
is_a: HP:0000002 ! Sleep disturbance

[Term]
id: HP:0000004
name: Microsleep
is_a: HP:0000003

[Term]
id: HP:0000005
name: Seizures
synonym: "Epileptic fit" EXACT []
is_a: HP:0000003

[Term]
id: HP:0000006
alt_id: HP:0000007
name: Fatigue
is_a: HP:0000003

[Term]
id: HP:0000009
name: Gone
is_obsolete: true
"""


@pytest.fixture(scope="module")
def terms(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("obo") / "x.obo"
    path.write_text(OBO)
    return readers.ontology_terms(readers.ontology_stanzas(spark, str(path)), "HP").cache()


def test_reader(terms):
    rows = {r.id: r for r in terms.collect()}
    assert len(rows) == 7 and rows["HP:0000009"].is_obsolete and rows["HP:0000002"].definition == "An abnormality of sleep."
    assert rows["HP:0000002"].synonyms == ["Disturbed sleep"] and rows["HP:0000002"].parents == ["HP:0000001"] and rows["HP:0000006"].alt_ids == ["HP:0000007"]


def test_wu_palmer(spark, terms):
    live = terms.where("not is_obsolete")
    closure = taxonomy.ancestor_closure(live.select(F.col("id").alias("code")), taxonomy.edges_of(terms))
    assert {r.code[-1]: r.depth for r in taxonomy.depths(closure).collect()} == {"1": 1, "2": 2, "3": 3, "4": 4, "5": 4, "6": 4}
    full = lambda x: f"HP:000000{x}"
    asked = spark.createDataFrame([(full(a), full(b)) for a, b in ((4, 4), (4, 5), (4, 7), (4, 6), (2, 3), (3, 4), (4, 8))], "x string, y string")
    codes = taxonomy.canonical_codes(live)
    pairs = asked.join(codes.select(F.col("given").alias("x"), F.col("code").alias("a")), "x", "left").join(codes.select(F.col("given").alias("y"), F.col("code").alias("b")), "y", "left")
    pairs = pairs.select("x", "y", F.coalesce("a", "x").alias("a"), F.coalesce("b", "y").alias("b"))
    got = {(r.x[-1], r.y[-1]): round(r.wu_palmer, 6) for r in taxonomy.wu_palmer(pairs, closure).collect()}
    assert got == {("4", "4"): 1.0, ("4", "5"): 0.75, ("4", "7"): 0.75, ("4", "6"): 0.75, ("2", "3"): 0.0, ("3", "4"): 0.857143, ("4", "8"): 0.0}


def test_cycles_fail(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    with pytest.raises(ValueError):
        taxonomy.ancestor_closure(edges.select(F.col("child").alias("code")), edges, levels=5)


def test_ontology_ladder(spark, terms):
    entries = ontology.search_entries(terms.where("not is_obsolete"))
    asked = spark.createDataFrame([(t,) for t in ("Seizures", "epileptic fit", "lack of sleep", "sleep", "HP:0000007", "seizure", "sleep disturbanse", "abnormality of sleep", "zzzz", "")], "term string")
    hits = ontology.search(asked, entries, ontology.token_postings(entries), aliases=ontology.ALIASES)
    top = {r.term: (r.label, r.match_type, r.score) for r in hits.where("rank = 1").collect()}
    assert top["Seizures"] == ("Seizures", "exact_label", 1.0)
    assert top["epileptic fit"] == ("Seizures", "synonym", 0.98)
    assert top["lack of sleep"] == ("Sleep disturbance", "exact_label", 0.95)
    assert top["HP:0000007"] == ("Fatigue", "id_lookup", 1.0)
    assert top["seizure"][:2] == ("Seizures", "token_label")
    assert top["sleep disturbanse"][0] == "Sleep disturbance"
    assert top["abnormality of sleep"][0] in ("Sleep disturbance", "Abnormal sleep quality") and "" not in top
    sleep = {r.label: r.match_type for r in hits.where("term = 'sleep'").collect()}
    assert sleep["Sleep disturbance"] == "substring_label" and sleep.get("Microsleep") != "substring_label"
    strict = ontology.resolve(asked, entries, ontology.token_postings(entries), "strict")
    assert strict.where("score < 0.7 or match_type like '%definition'").count() == 0
    with pytest.raises(ValueError):
        ontology.resolve(asked, entries, ontology.token_postings(entries), "odd")


def test_set_similarity_invariants(spark):
    def score(query, candidate):
        frame = spark.createDataFrame([(query, candidate)], "q array<string>, c array<string>")
        sim = lambda x, y: F.when(x == y, 1.0).when(F.substring(x, 1, 1) == F.substring(y, 1, 1), 0.25).otherwise(0.0)
        return frame.select(similarity.array_set_similarity(F.col("q"), F.col("c"), sim).alias("s")).first().s

    assert score(["insomnia", "headache"], ["headache", "insomnia"]) == 1.0
    assert score(["a"], []) is None
    assert score(["fever", "cough"], ["fever", "zzz"]) > score(["fever", "cough"], ["fx", "cx", "fy"])


def test_capped_top(spark):
    rows = spark.createDataFrame([(i, c, float(20 - i)) for i, c in enumerate([1] * 5 + [2] * 3 + [3] * 2)], "case_id int, case_no int, s double")
    top = lambda k: [r.case_no for r in similarity.capped_top(rows, k, [F.desc("s")]).collect()]
    assert sorted(top(6)) == [1, 1, 2, 2, 3, 3] and sorted(top(5)) == [1, 2, 3]
    free = rows.withColumn("case_no", F.lit(None).cast("int"))
    assert similarity.capped_top(free, 6, [F.desc("s")]).count() == 6


def test_rank_medicines(spark):
    pairs = spark.createDataFrame([("q", 1, 1.0, 0.9), ("q", 2, 0.9, 0.8), ("q", 3, 0.1, 0.1), ("q", 4, 1.0, 1.0)], "query string, case_id int, lca double, cos double")
    cases = spark.createDataFrame([(1, 14.0, "m"), (2, 15.0, "m"), (3, 14.0, "m"), (4, 52.0, "m")], "case_id int, age double, gender string")
    meds = spark.createDataFrame([(1, 0, "A", "x", False), (1, 1, "B", "y", False), (1, 2, "a", "z", False), (2, 0, "A", "x", True), (2, 1, "C", "x", False), (3, 0, "D", "x", False), (4, 0, "E", "x", False)], "case_id int, pos int, molecule string, brand string, is_fdc boolean")
    got = ranking.rank_medicines(pairs, cases, meds, ["query"], age=F.lit(13.0)).orderBy("rank").collect()
    assert [r.molecule for r in got] == ["A", "B", "C"] and got[0].frequency == 2 and got[0].brands == ["x"] and got[0].percentage == 100.0 and got[0].is_fdc
    every = {r.molecule for r in ranking.rank_medicines(pairs, cases, meds, ["query"]).collect()}
    assert every == {"A", "B", "C", "E"}


def test_medicine_tiers(spark):
    master = spark.createDataFrame([("ZOLAVIL", "Etizolam", 0), ("RECTIN 20", "Duloxetine", 1), ("RECTIN", "Duloxetine", 2)], "brand_name string, canonical_molecule string, ordinal int")
    asked = spark.createDataFrame([(t,) for t in ("tab zola-vil", "Rectin 20 mg", "etizolam 5", "duloxe", "zz", " ", None)], "term string")
    got = {r.term: (r.tier, r.ordinal) for r in medicines.match_medicines(asked, master).collect()}
    assert got == {"tab zola-vil": (1, 0), "Rectin 20 mg": (2, 1), "etizolam 5": (3, 0), "duloxe": (4, 1)}
    vectors = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0])], "brand_name string, embedding array<double>")
    found = medicines.vector_search(vectors, [1.0, 0.0, 0.0], 5, 0.5).collect()
    assert [(r.brand_name, r.score) for r in found] == [("a", 1.0)] and "embedding" not in found[0]


def test_delta(spark):
    frame = spark.createDataFrame(
        [(1, ["denies paranoia currently", "Informant: wife", "less insomnia", "new tremor"], ["mdd"], ["paranoia", "severe anxiety", "insomnia"], ["gad", "MDD"]), (2, ["cough", "no fever"], ["? flu."], None, None)],
        "id int, symptoms array<string>, diagnoses array<string>, past_symptoms array<string>, past_diagnoses array<string>",
    )
    a, b = delta.encounter_delta(frame).orderBy("id").collect()
    assert a.stop_symptoms == ["paranoia"] and a.decreased_symptoms == ["less insomnia"] and a.new_symptoms == ["new tremor"]
    assert "severe anxiety" not in a.stop_symptoms and a.stop_diagnoses == ["gad"] and a.maintained_diagnoses == ["mdd"]
    assert b.new_symptoms == ["cough"] and b.new_diagnoses == ["flu"] and b.stop_symptoms == []
    rows = {(r.id, r.status, r.entity) for r in delta.long_form(delta.encounter_delta(frame), ["id"]).collect()}
    assert (1, "stop", "gad") in rows and (2, "new", "cough") in rows


def test_evaluation(spark):
    frame = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "c"]), (2, [], []), (3, [], ["z"])], "id int, e array<string>, p array<string>")
    got = frame.select("id", *(c.alias(n) for n, c in evaluation.case_evaluation(F.col("e"), F.col("p")).items())).orderBy("id").collect()
    assert (got[0].expected_count, got[0].matched_count, round(got[0].accuracy, 2), got[0].extra_prescribed) == (3, 2, 66.67, ["c"])
    assert [got[1].accuracy, got[2].accuracy] == [100.0, 0.0]
    recall = frame.select(evaluation.set_recall(F.col("e"), F.col("p")).alias("r")).collect()
    assert [r.r for r in recall] == [0.5, 1.0, 0.0]


def test_upserts(spark):
    table = spark.createDataFrame([(1, "a", 1.0, "x"), (2, "b", 2.0, "y"), (None, "n", 0.0, "z")], "k int, name string, v double, _id string")
    updates = spark.createDataFrame([(2, "B", None), (3, "c", 3.0), (None, "N", 9.0)], "k int, name string, v double")
    got = {r.k: r for r in upsert.upsert(table, updates, ["k"], new_id="_id").collect()}
    assert len(got) == 4 and got[2].name == "B" and got[2].v is None and got[2]._id == "y" and got[None].name == "N" and got[3]._id and got[1].name == "a"
    patched = {r.k: r.v for r in upsert.patch_column(table, updates, "k", "v").collect()}
    assert patched == {1: 1.0, 2: None, None: 9.0}
    schema = "brand_name string, canonical_molecule string, dosage_group_id string, form string"
    master = spark.createDataFrame([("B", "M", "g1", "tab"), ("B", "M", "g2", "tab")], schema)
    new = spark.createDataFrame([("B", "M", None, "cap"), ("B", "M", "g2", "syp"), ("Q", "R", None, "inj")], schema)
    got = sorted((r.brand_name, r.dosage_group_id or "", r.form) for r in upsert.upsert_medicines(master, new).collect())
    assert got == [("B", "g1", "cap"), ("B", "g2", "cap"), ("Q", "", "inj")]


def test_encounters(spark):
    visits = spark.createDataFrame([(1, "2024-01-02"), (1, "2024-03-01"), (2, "2023-01-01")], "case_no int, visit_date string").withColumn("visit_date", F.col("visit_date").cast("date"))
    people = spark.createDataFrame([(1, "f")], "case_no int, gender string")
    empty = visits.limit(0)
    dx = visits.withColumn("diagnosis", F.lit("d")).unionByName(visits.where("case_no = 1").withColumn("diagnosis", F.lit("c")))
    got = encounters.assemble(visits, people, empty.withColumn("chief_complaints", F.lit("x")), dx, empty.withColumn("medicine", F.lit("m"))).collect()
    assert len(got) == 3 and {r.diagnosis_names for r in got if r.case_no == 1} == {"c, d"} and sum(r.is_latest for r in got) == 2
    past = encounters.past_visits(visits, 1, F.lit("2024-03-01").cast("date")).collect()
    assert [str(r.visit_date) for r in past] == ["2024-01-02"]


@pytest.mark.parametrize("blocks", [(8192, 4096), (7, 3)])
def test_cosine_topk_of_all_queries(spark, blocks):
    import math
    import random

    rng = random.Random(4)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(5)] for i in range(1, 130)}  # no row 0
    vectors |= {20: None, 21: [0.0] * 5, 22: [1.0, None, 0.0, 0.0, 0.0], 23: [1.0, 2.0], 24: vectors[40], 25: vectors[40], 60: [1.0, 2.0, 3.0]}

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return 0.0
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 4)

    rows = spark.createDataFrame([*vectors.items(), (None, [1.0] * 5)], "vec_id long, embedding array<float>")
    got = similarity.cosine_topk(rows, rows.where("vec_id % 20 = 0"), 10, *blocks).collect()
    found = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in range(20, 130, 20)}
    for q in found:
        best = sorted((-cosine(vectors[q], e), i) for i, e in vectors.items() if i != q)[:10]
        assert [i for i, _ in found[q]] == [i for _, i in best]
        assert found[q] == [(i, pytest.approx(-s, abs=1e-4)) for s, i in best]
    assert sorted({r.query_id for r in got}) == sorted(found)
    assert similarity.cosine_topk(rows.limit(0), rows).collect() == [] and similarity.cosine_topk(rows, rows.limit(0)).collect() == []
