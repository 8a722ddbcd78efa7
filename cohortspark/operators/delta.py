"""What changed between a case's past and its current encounter, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import triage as R

NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(NONE)


def first_match(target: Column, candidates: Column) -> Column:
    """The first of the candidates that equals the target, else the first that holds it or is held by it, letters' case aside."""

    def found(low: Column) -> Column:
        same = F.get(F.filter(candidates, lambda c: F.lower(c) == low), F.lit(0))
        near = F.get(F.filter(candidates, lambda c: F.lower(c).contains(low) | low.contains(F.lower(c))), F.lit(0))
        return F.coalesce(same, near)

    return R.bound(F.lower(F.trim(target)), found)


def encounter_delta(encounters: DataFrame, symptoms: str = "symptoms", diagnoses: str = "diagnoses", past_symptoms: str = "past_symptoms", past_diagnoses: str = "past_diagnoses") -> DataFrame:
    """Adds eight arrays of terms by status, and the medicines a patient reports using and having stopped.

    Symptoms that are not mentioned are not resolved; diagnoses that are not
    listed any more are.  Without history every active term is new.
    """
    current, past = F.coalesce(F.col(symptoms), _empty()), F.coalesce(F.col(past_symptoms), _empty())
    low_past = F.array_distinct(F.filter(F.transform(past, lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    out = encounters.withColumns(
        {
            "__past": low_past,
            "__active": F.array_distinct(F.filter(F.transform(current, lambda s: F.when(R.complaint_category(s) == "symptom", F.trim(s))), lambda x: x.isNotNull())),
            "__denied": F.filter(F.transform(current, lambda s: F.when(R.complaint_category(s) == "negated_symptom", R.negated_entity(s))), lambda x: x.isNotNull()),
            "__dx": F.array_distinct(F.filter(F.transform(F.coalesce(F.col(diagnoses), _empty()), X.clean_diagnosis), lambda x: x != "")),
            "__past_dx": F.array_distinct(F.filter(F.transform(F.coalesce(F.col(past_diagnoses), _empty()), lambda x: F.lower(X.clean_diagnosis(x))), lambda x: x != "")),
        }
    )
    tracked = F.filter(F.transform("__past", lambda p: F.struct(first_match(p, F.col("__active")).alias("term"), p.alias("past"))), lambda x: x["term"].isNotNull())
    out = out.withColumn("__moves", F.transform(tracked, lambda x: F.struct(x["term"].alias("term"), R.change_class(x["term"], F.array(x["past"])).alias("status"))))
    of = lambda *status: F.array_distinct(F.transform(F.filter("__moves", lambda x: x["status"].isin(*status)), lambda x: x["term"]))
    stopped = F.transform("__denied", lambda d: F.coalesce(first_match(d, F.col("__past")), d))
    unknown = lambda terms, known: F.filter(terms, lambda t: first_match(t, F.col(known)).isNull())
    heard = lambda f: F.array_distinct(F.filter(F.transform(current, f), lambda x: x.isNotNull()))
    return out.withColumns(
        {
            "new_symptoms": unknown("__active", "__past"),
            "maintained_symptoms": of("maintained", "new"),
            "decreased_symptoms": of("decreased"),
            "increased_symptoms": of("increased"),
            "stop_symptoms": F.array_distinct(F.concat(F.when(F.size("__past") + F.size("__past_dx") > 0, stopped).otherwise(_empty()), of("stop"))),
            "new_diagnoses": unknown("__dx", "__past_dx"),
            "maintained_diagnoses": F.array_distinct(F.filter(F.transform("__past_dx", lambda p: first_match(p, F.col("__dx"))), lambda x: x.isNotNull())),
            "stop_diagnoses": unknown("__past_dx", "__dx"),
            "patient_reported_current_use": heard(R.medicine_in_use),
            "actual_discontinuation": heard(R.medicine_discontinued),
        }
    ).drop("__past", "__active", "__denied", "__dx", "__past_dx", "__moves")


STATUSES = {
    "decreased_symptoms": ("symptom", "decreased"), "increased_symptoms": ("symptom", "increased"), "stop_symptoms": ("symptom", "stop"), "maintained_symptoms": ("symptom", "maintained"), "new_symptoms": ("symptom", "new"),
    "stop_diagnoses": ("diagnosis", "stop"), "maintained_diagnoses": ("diagnosis", "maintained"), "new_diagnoses": ("diagnosis", "new"),
}


def long_form(delta: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entity_type, status, entity): one row a term of a delta."""

    def named(column: str, kind: str, status: str) -> Column:
        return F.transform(F.col(column), lambda t: F.struct(F.lit(kind).alias("entity_type"), F.lit(status).alias("status"), t.alias("entity")))

    parts = [named(c, kind, status) for c, (kind, status) in STATUSES.items()]
    return delta.select(*keys, F.explode(F.concat(*parts)).alias("e")).select(*keys, "e.*")


def delta_status(term: Column, past: Column) -> Column:
    """A term's status in a delta's arrays, looked up in fixed priority; by its words where it is in none."""
    low = F.lower(F.trim(term))
    out = None
    for column, (_, status) in STATUSES.items():
        here = F.exists(column, lambda x: F.lower(F.trim(x)) == low)
        out = F.when(here, status) if out is None else out.when(here, status)
    return out.otherwise(R.change_class(term, past))


def summary_text(delta: DataFrame) -> DataFrame:
    """A short report of a delta's lists in the column clinical_summary."""
    line = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(c.replace("_", " ").capitalize() + ": "), F.array_join(F.col(c), ", ")))
    return delta.withColumn("clinical_summary", F.concat_ws("\n", *(line(c) for c in STATUSES)))


def matched_item(name: Column, items: Column) -> Column:
    """The item (a struct with name) of an answer for a keyword item: equal names first, then one inside the other, in order."""

    def found(low: Column) -> Column:
        same = F.get(F.filter(items, lambda i: F.lower(F.trim(i["name"])) == low), F.lit(0))
        return F.coalesce(same, F.get(F.filter(items, lambda i: F.lower(i["name"]).contains(low) | low.contains(F.lower(i["name"]))), F.lit(0)))

    return R.bound(F.lower(F.trim(name)), found)
