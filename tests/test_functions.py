import math

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import dates as D
from cohortspark.functions import identifiers as I
from cohortspark.functions import text as X
from cohortspark.functions import triage as R
from cohortspark.functions import vectors as V


def one(spark, column, **values):
    """The value of a column over one row of literals."""
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return frame.select(column.alias("r")).first()["r"]


def each(spark, function, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.r for r in frame.select("i", function(F.col("t")).alias("r")).orderBy("i").collect()]


def test_terms_are_trimmed_as_by_the_pattern(spark):
    import itertools

    by_pattern = lambda t: F.filter(F.transform(F.split(t, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    marks = [" ", "\t", "\n", "\x0b", "\f", "\r", "\x85", "\u2028", "\u2029", "\xa0", "\x1c", "a", ","]
    texts = ["".join(x) for n in range(5) for x in itertools.product(marks, repeat=n) if n < 4 or "a" in x[:2]]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert frame.where(~X.comma_terms(F.col("t")).eqNullSafe(by_pattern(F.col("t")))).isEmpty()
    assert each(spark, X.comma_terms, [None, " a ,, b\n"]) == [[], ["a", "b"]]


def test_sanitize_and_segment(spark):
    assert each(spark, X.sanitize, ["★ • 60% cough, ++fever, ?GTCS", "", None, "ﬁne\n\n  — x "]) == ["60% cough, ++fever, ?GTCS", "", None, "fine\nx"]
    got = each(spark, X.segment, ["● a, b; c .\n● second\n●third● ", None])
    assert got == [["a, b; c", "second", "third"], None]


def test_terms(spark):
    assert each(spark, X.clean_diagnosis, ["- ? mdd with anxious distress . ", "???", None, "x"]) == ["mdd with anxious distress", "", "", "x"]
    assert each(spark, lambda c: X.to_curie("HPO", c), ["13600", "HPO:2189", "HP:5200289", None, "unmatched", "none"]) == ["HP:0013600", "HP:0002189", "HP:5200289", None, None, None]
    assert each(spark, lambda c: X.to_curie("mondo", c), ["8807"]) == ["MONDO:0008807"]
    assert each(spark, X.complaint_terms, ["● a\r\n b ●", None]) == [["a", "b"], []]
    assert each(spark, X.strip_dose_forms, ["Tab. ZOLAVIL", "zolavil capsule"]) == ["ZOLAVIL", "zolavil"]
    assert each(spark, X.strip_special, ["low (mood) [x]!", "(all)", None]) == ["low", "all", ""]
    assert each(spark, X.base_run_id, ["run_1_step2_prompt", "run_1", "_triage"]) == ["run_1", "run_1", "_triage"]


@pytest.mark.parametrize(
    ("molecule", "brand", "indication", "expected"),
    [
        ("Etizolam", "ZOLAVIL", "Short-term bridge therapy.", "Etizolam, marketed as ZOLAVIL, is used as short-term bridge therapy."),
        ("Duloxetine", "RECTIN", "SNRI therapy", "Duloxetine, marketed as RECTIN, is used as SNRI therapy."),
        ("Acetylsalicylic acid", "ASPIRIN", "", "Acetylsalicylic acid, marketed as ASPIRIN."),
        (None, None, None, "Medication."),
        ("M", None, "Adjuvant", "M is used as adjuvant."),
    ],
)
def test_digest(spark, molecule, brand, indication, expected):
    assert one(spark, X.digest_sentence(*(F.lit(v).cast("string") for v in (molecule, brand, indication)))) == expected


def test_component_tokens(spark):
    def tokens(brand, molecule, strengths, mode):
        return one(spark, X.component_tokens(F.lit(brand), F.lit(molecule), F.create_map(*[F.lit(x) for p in strengths.items() for x in p]) if strengths else F.lit(None).cast("map<string,double>"), mode))

    assert tokens("B", "A + C", {"X": 1.0, "Y": 2.0}, "fdc_broken") == ["x", "y"]
    assert tokens("B", "A + C", {"X": 1.0}, "fdc_broken") == ["a", "c"]
    assert tokens("B", "A", {"X": 1.0}, "fdc_broken") == ["x"]
    assert tokens("B", "A", None, "fdc_broken") == ["a"]
    assert tokens("B", "", None, "fdc_broken") == ["b"]
    assert tokens("B", "A", None, "brand") == ["b"]
    with pytest.raises(ValueError):
        X.component_tokens(F.lit("a"), F.lit("b"), F.lit(None), "other")


def test_dates(spark):
    got = each(spark, D.clinical_date, ["12/09/2025", "2025-10-08", "8/1/2024 10:00", "31/02/2024", "unknown", "", None])
    assert [str(x) if x else None for x in got] == ["2025-09-12", "2025-10-08", "2024-01-08", None, None, None, None]
    day = lambda s: F.lit(s).cast("date")
    expected = {"2025-10-08": "today", "2025-10-07": "yesterday", "2025-10-04": "4 days ago", "2025-09-12": "3 weeks ago", "2025-08-01": "2 months ago", "2023-01-01": "2 years ago", "2025-12-01": "2025-12-01"}
    for past, text in expected.items():
        assert one(spark, D.relative_time(day(past), day("2025-10-08"))) == text


def test_similarities(spark):
    sim = lambda a, b: one(spark, V.age_similarity(F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert sim(30, 30) == 1.0
    near, far = sim(20, 30), sim(20, 50)
    assert 0.5 < near < 1 and 0 < far < near
    assert sim(None, 3) is None and sim(13, 55) == 0.0 and sim(-1, 3) is None
    demographic = lambda a, b, g, h: one(spark, V.demographic_similarity(F.lit(a).cast("double"), F.lit(b).cast("double"), F.lit(g).cast("string"), F.lit(h).cast("string")))
    assert demographic(13, 55, "m", "male") == 0.0
    assert demographic(30, 30, "Male", "m") == 1.0 and demographic(None, 30, "f", "male") == 0.0 and demographic(30, 30, None, "m") == 1.0
    assert one(spark, V.visit_type_similarity(F.lit("follow-up"), F.lit("Follow-up Visit"))) == 1.0
    assert one(spark, V.visit_type_similarity(F.lit("follow-up"), F.lit("new consultation"))) == 0.5
    assert round(one(spark, V.composite([(F.lit(1.0), 0.4), (F.lit(None).cast("double"), 0.4), (F.lit(0.5), 0.1), (F.lit(1.0), 0.1)])), 6) == 0.916667
    assert one(spark, V.composite([(F.lit(None).cast("double"), 1.0)])) == 0.0
    arr = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, V.cosine(arr(1, 0), arr(1, 1))) == pytest.approx(math.sqrt(0.5))
    assert one(spark, V.cosine(arr(0, 0), arr(1, 1))) == 0.0
    assert one(spark, V.term_similarity(F.lit("Fever"), F.lit("fever "), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0.1), F.lit(None).cast("double"))) == 1.0
    assert one(spark, V.term_similarity(F.lit("a"), F.lit("b"), F.lit(1), F.lit(2), F.lit(0.8), F.lit(0.4))) == pytest.approx((0.6 - 0.3) / 0.7)
    assert one(spark, V.idf_weight(F.lit(1))) == pytest.approx(math.log(1001 / 2) + 1)


def test_triage(spark):
    category = lambda texts: each(spark, R.complaint_category, texts)
    assert set(category(["Informant: patient", "labs advised", "review in 1 month", "follow-up", "", None, "History given by mother"])) == {"non_symptom"}
    assert set(category(["Feels much better", "symptom free", "no complaints", "nil", "doing fine", "overall stable"])) == {"global_status"}
    assert each(spark, R.complaint_entity, ["denies paranoia currently", "insomnia resolved", "free of tremors", "no fever"]) == ["paranoia", "insomnia", "tremors", "fever"]
    assert each(spark, R.complaint_entity, ["loss of appetite", "moderate insomnia", "labs"]) == ["loss of appetite", "moderate insomnia", None]
    assert each(spark, R.medicine_in_use, ["currently taking tab clonazepam 0.5mg hs", "on escitalopram 10mg", "stopped fluoxetine 20mg", "taking meds", None]) == ["clonazepam 0.5mg hs", "escitalopram 10mg", None, None, None]
    assert each(spark, R.medicine_discontinued, ["stopped fluoxetine 20mg 2 weeks ago"]) == ["fluoxetine 20mg 2 weeks"]
    assert each(spark, R.assertion_status, ["no fever", "loss of appetite", "h/o asthma", "?GTCS", "mother has diabetes", "fever"]) == ["negated", "affirmed", "historical", "uncertain", "family", "affirmed"]
    assert each(spark, lambda c: R.canonical_status(c), ["Improving", "same", "odd", None]) == ["decreased", "maintained", None, None]


def test_json_answers(spark):
    texts = ['x\n```json\n{"a": 1}\n```', 'so {"a": 2} ok', "none", None]
    assert each(spark, lambda c: F.try_variant_get(R.json_answer(c), "$.a", "int"), texts) == [1, 2, None, None]


def test_source_fields(spark):
    assert each(spark, I.case_number, ["DT100", "7", "none", None]) == [100, 7, None, 0]
    assert each(spark, I.source_gender, ["Female", "m", None]) == ["f", "m", "m"]
    assert one(spark, I.fractional_age(F.lit("30"), F.lit("5"), F.lit("x"))) == 30.42
    assert each(spark, I.consultation_type, ["New Consultation", "follow up", "", None, "home visit"]) == ["New Consultation", "Follow-up", "Unknown", "Unknown", "Home Visit"]
    assert [one(spark, I.count_bucket(F.lit(n))) for n in (0, 5, 6)] == ["0", "5", "5+"]
    assert [one(spark, I.age_group(F.lit(a))) for a in (5, 12, 21, 45, 65, 66)] == ["0-5", "6-12", "12-21", "22-45", "46-65", "65+"]
