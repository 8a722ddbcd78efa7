"""Assessment of an encounter's complaints: keyword marks, a model's answer merged into them, and the delta they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as N
from ..functions import triage as R
from . import delta as D

# How a status is shown.
SHOWN = {"decreased": "improved", "increased": "worsened", "stop": "resolved", "new": "new", "maintained": "maintained"}
# Sentences and headings of the reports.
ADMINISTRATIVE = "Administrative metadata or clinical directive (non-symptom)"
WHOLE_PATIENT = "Whole-patient condition statement (global status)"
FOLLOW_UP = "Follow-up consultation review"
BASELINE = "Initial baseline consultation"
NO_ACTIVE = "No active symptoms reported."
NO_COMPLAINTS = "No chief complaints recorded for current visit."
NOTHING_TO_ASSESS = "No symptoms to assess."
NO_SYMPTOMS = "No symptoms recorded at this visit."
NO_CHANGES = "No medication changes required; continuing current clinical management."
NONE_ACTIVE = "- no active symptoms reported"
COMPLAINTS_HEAD = "current visit chief complains:"
DIAGNOSES_HEAD = "current diagnosis:"
NOTES_HEAD = "clinical notes:"
NONE_RECORDED = "none recorded"
CATEGORIES = ("symptom", "negated_symptom", "global_status", "non_symptom")


def _shown(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair]), status)


def keyword_marks(rows: DataFrame, symptoms: str = "symptoms", past: str = "past_symptoms", name: str = "marks") -> DataFrame:
    """Adds an array of what keywords say of each complaint that is not blank, in order.

    Fields: complaint, category, canonical_entity, matched_past, condition_note,
    status and display_status; a category stands as the display status of
    complaints that are no symptom.
    """
    history = F.array_distinct(F.filter(F.transform(F.coalesce(past, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))

    def told(m: Column, text: Column, past_terms: Column) -> Column:
        denied, active = m["category"] == "negated_symptom", m["category"] == "symptom"
        entity = F.when(denied, F.coalesce(m["denied"], text)).when(active, text)
        return F.struct(m["category"].alias("category"), entity.alias("entity"), R.symptom_condition(entity, past_terms).alias("condition"), F.when(denied, "stop").when(active, R.change_class(text, past_terms)).alias("status"))

    def mark(text: Column, m: Column) -> Column:
        denied, category = m["category"] == "negated_symptom", m["category"]
        note = (
            F.when(category == "non_symptom", ADMINISTRATIVE)
            .when(category == "global_status", WHOLE_PATIENT)
            .when(denied, F.concat(F.lit("Negated/denied symptom, canonical entity '"), m["entity"], F.lit("'")))
            .otherwise(m["condition"]["note"])
        )
        matched = F.when(category.isin("negated_symptom", "symptom"), m["condition"]["matched"])
        return F.struct(text.alias("complaint"), category.alias("category"), m["entity"].alias("canonical_entity"), matched.alias("matched_past"), note.alias("condition_note"), m["status"].alias("status"), F.coalesce(_shown(m["status"]), category).alias("display_status"))

    # each step names the last one's values as often as it likes, and they are computed once
    def marked(text: Column, past_terms: Column) -> Column:
        categorised = lambda denied: F.struct(denied.alias("denied"), R.complaint_category(text, denied).alias("category"))
        return R.bound(R.negated_entity(text), lambda d: R.bound(categorised(d), lambda m: R.bound(told(m, text, past_terms), lambda t: mark(text, t))))

    listed = F.filter(F.transform(F.coalesce(symptoms, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")
    return rows.withColumn(name, R.bound(F.struct(listed.alias("listed"), history.alias("history")), lambda r: F.transform(r["listed"], lambda text: marked(text, r["history"]))))


def _item(raw: Column, category: Column, entity: Column, status: Column, shown: Column, change: Column, notes: Column, mark: Column) -> Column:
    changed = F.coalesce(shown != mark["display_status"], shown.isNotNull()) | (category != mark["category"])
    return F.struct(
        raw.alias("raw_text"), category.alias("category"), entity.alias("canonical_entity"), status.alias("status"), shown.alias("display_status"), change.alias("change_description"), notes.alias("notes"),
        mark["display_status"].alias("heuristic_mark"), mark["category"].alias("heuristic_category"), changed.alias("changed"),
    )


def _named(items: Column, category: str) -> Column:
    return F.array_distinct(F.transform(F.filter(items, lambda i: i["category"] == category), lambda i: F.coalesce(i["canonical_entity"], i["raw_text"])))


def keyword_assessment(rows: DataFrame, marks: str = "marks") -> DataFrame:
    """The assessment that keywords give alone: triaged_items, active_symptoms, resolved_symptoms, global_status_notes, patient_condition and symptom_notes.

    ``rows`` has ``marks`` and, for the condition, ``past_symptoms``.
    """

    def item(m: Column) -> Column:
        active, denied = m["category"] == "symptom", m["category"] == "negated_symptom"
        change = F.when(denied, F.concat(F.lit("Resolved / negated ("), m["complaint"], F.lit(")"))).when(active & m["matched_past"].isNotNull(), F.concat(m["display_status"], F.lit(", changed from "), m["matched_past"])).otherwise(m["condition_note"])
        return _item(m["complaint"], m["category"], m["canonical_entity"], m["status"], m["display_status"], change, F.concat(F.lit("Heuristic triage: "), m["category"]), m)

    def line(i: Column) -> Column:
        entity = F.coalesce(i["canonical_entity"], i["raw_text"])
        return F.when(i["category"] == "symptom", F.concat(entity, F.lit(": "), i["change_description"])).when(i["category"] == "negated_symptom", F.concat(entity, F.lit(": resolved / denied"))).when(i["category"] == "global_status", F.concat(F.lit("Patient reports "), F.lower(i["raw_text"])))

    out = rows.withColumn("triaged_items", F.transform(marks, item))
    out = out.withColumns({"active_symptoms": _named(F.col("triaged_items"), "symptom"), "resolved_symptoms": _named(F.col("triaged_items"), "negated_symptom"), "global_status_notes": F.array_distinct(F.transform(F.filter("triaged_items", lambda i: i["category"] == "global_status"), lambda i: i["raw_text"]))})
    told = F.filter(F.transform("triaged_items", line), lambda x: x.isNotNull())
    seen = F.size(F.coalesce("past_symptoms", F.array().cast("array<string>"))) > 0
    condition = F.when(F.size("global_status_notes") > 0, F.concat(F.lit("Overall status: "), F.array_join("global_status_notes", ", "))).when(seen, FOLLOW_UP).otherwise(BASELINE)
    return out.withColumns({"patient_condition": condition, "symptom_notes": F.when(F.size(told) > 0, F.array_join(told, " | ")).otherwise(NO_ACTIVE)})


def answered_items(marks: Column, items: Column) -> Column:
    """Marks corrected by an answer's items: category, entity, status and notes are the answer's where it has valid ones.

    An item belongs to the complaint of its name, or else to one that holds it
    or is held by it; a denied symptom is always resolved.
    """

    def categorised(m: Column, found: Column) -> Column:
        category = R.bound(F.lower(F.trim(found["category"])), lambda given: F.when(given.isin(*CATEGORIES), given).otherwise(m["category"]))
        return F.struct(found.alias("found"), category.alias("category"))

    def corrected(m: Column, told: Column) -> Column:
        found, category = told["found"], told["category"]
        said = R.bound(F.lower(F.trim(found["canonical_entity"])), lambda x: F.when(x != "", x))
        entity = F.coalesce(said, m["canonical_entity"], F.when(category == "negated_symptom", R.negated_entity(m["complaint"])))
        canonical = F.when(category == "negated_symptom", "stop").otherwise(R.canonical_status(found["status"], m["status"]))
        shown = F.when(category == "negated_symptom", "resolved").otherwise(F.coalesce(R.displayed_status(found["status"]), m["display_status"]))
        change = F.when(found.isNotNull(), F.coalesce(found["change_description"], F.lit(""))).otherwise(F.coalesce(m["condition_note"], F.lit("")))
        return R.bound(shown, lambda s: _item(m["complaint"], category, entity, canonical, s, change, F.coalesce(found["notes"], F.lit("")), m))

    # found and categorised once an item, whatever names them
    return F.transform(marks, lambda m: R.bound(D.matched_item(m["complaint"], items), lambda found: R.bound(categorised(m, found), lambda told: corrected(m, told))))


def assessed(rows: DataFrame, answer: str | None = None, marks: str = "marks") -> DataFrame:
    """``keyword_assessment``, and where the column ``answer`` holds a model's answer that can be read, the answer merged into it.

    Adds used_llm, whats_changed and deprescribing_recommendations, empty
    without an answer.  Rows without complaints say so.
    """
    out = keyword_assessment(rows, marks)
    read = N.triage_answer(F.col(answer) if answer else F.lit(None).cast("string"))
    out = out.withColumn("__a", read)
    used = F.col("__a").isNotNull() & (F.size(marks) > 0)
    items = F.when(used, answered_items(F.col(marks), F.col("__a.triaged_items"))).otherwise(F.col("triaged_items"))
    out = out.withColumns({"triaged_items": items, "used_llm": used})
    none = F.size(marks) == 0
    prefer = lambda field, own: F.when(used & (F.col(f"__a.{field}") != ""), F.col(f"__a.{field}")).when(used, "").otherwise(own)
    return out.withColumns(
        {
            "active_symptoms": _named(F.col("triaged_items"), "symptom"),
            "resolved_symptoms": _named(F.col("triaged_items"), "negated_symptom"),
            "global_status_notes": F.array_distinct(F.transform(F.filter("triaged_items", lambda i: i["category"] == "global_status"), lambda i: i["raw_text"])),
            "patient_condition": F.when(none, NO_COMPLAINTS).otherwise(prefer("patient_condition", F.col("patient_condition"))),
            "symptom_notes": F.when(none, NOTHING_TO_ASSESS).otherwise(prefer("symptom_notes", F.col("symptom_notes"))),
            "whats_changed": F.when(none, NO_SYMPTOMS).when(used, F.col("__a.whats_changed")).otherwise(""),
            "deprescribing_recommendations": F.when(used, F.col("__a.deprescribing_recommendations")).otherwise(F.array().cast(out.schema["__a"].dataType["deprescribing_recommendations"].dataType)),
            "answered_use": F.when(used & (F.size("__a.patient_reported_current_use") > 0), F.col("__a.patient_reported_current_use")),
            "answered_discontinuation": F.when(used & (F.size("__a.actual_discontinuation") > 0), F.col("__a.actual_discontinuation")),
        }
    ).drop("__a")


def triage_report(items: Column) -> Column:
    """Triaged items under the names of the report, some of them twice."""
    return F.transform(
        items,
        lambda i: F.struct(
            i["raw_text"].alias("complaint"), i["category"].alias("category"), i["canonical_entity"].alias("canonical_entity"), i["status"].alias("status"), i["display_status"].alias("display_status"), i["display_status"].alias("llm_status"), i["category"].alias("llm_category"),
            i["heuristic_mark"].alias("heuristic_mark"), i["heuristic_category"].alias("heuristic_category"), i["changed"].alias("changed"), i["change_description"].alias("change_description"), i["notes"].alias("notes"),
        ),
    )


def _past_term(entity: Column, past: Column) -> Column:
    """The past term that an entity stands for: by its name, or by the first shared word that counts."""
    shared = F.get(F.filter(past, lambda p: F.coalesce(F.arrays_overlap(R.core_tokens(entity), R.core_tokens(p)), F.lit(False))), F.lit(0))
    return F.coalesce(D.first_match(entity, past), shared)


def assessed_delta(rows: DataFrame, items: str | None = "triaged_items", legacy: str | None = None) -> DataFrame:
    """``encounter_delta`` with symptoms placed by an assessment instead of by keywords.

    Triaged items come first: symptoms by their status, denied ones under the
    past term they stand for, other categories nowhere.  Rows without items but
    with ``legacy`` results (complaint, confirmed_status) go by these, all
    others by keywords.  Without history every active symptom is new.  What an
    answer says of medicines replaces what the complaints say.
    """
    out = D.encounter_delta(rows)
    empty = F.array().cast("array<string>")
    low_past = F.array_distinct(F.filter(F.transform(F.coalesce("past_symptoms", empty), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    past_dx = F.coalesce("past_diagnoses", empty)
    out = out.withColumn("__past", low_past)
    history = (F.size("__past") > 0) | (F.size(past_dx) > 0)
    columns = ("new", "maintained", "decreased", "increased", "stop")

    def by_status(entries: Column, name, status, status_name: str) -> Column:
        known = ("maintained", "decreased", "increased", "stop")
        fits = (lambda e: status(e) == status_name) if status_name != "new" else (lambda e: ~F.coalesce(status(e).isin(*known), F.lit(False)))
        return F.array_distinct(F.transform(F.filter(entries, fits), name))

    if legacy:
        listed = F.coalesce(legacy, F.array().cast(out.schema[legacy].dataType))
        for c in columns:
            mine = by_status(listed, lambda e: e["complaint"], lambda e: e["confirmed_status"], c)
            out = out.withColumn(f"{c}_symptoms", F.when((F.size(listed) > 0) & history, mine).otherwise(F.col(f"{c}_symptoms")))
    if items:
        listed = F.coalesce(items, F.array().cast(out.schema[items].dataType))
        there = F.size(listed) > 0
        entity = lambda e: F.trim(F.coalesce(e["canonical_entity"], e["raw_text"]))
        denied = lambda e: F.trim(F.coalesce(e["canonical_entity"], R.negated_entity(e["raw_text"]), e["raw_text"]))
        # in the items' order, denied and stopped ones together
        stopped = F.transform(F.filter(listed, lambda e: (e["category"] == "negated_symptom") | ((e["category"] == "symptom") & (e["status"] == "stop"))), lambda e: F.when(e["category"] == "negated_symptom", F.coalesce(_past_term(denied(e), F.col("__past")), denied(e))).otherwise(entity(e)))
        active = F.filter(listed, lambda e: e["category"] == "symptom")
        for c in columns:
            mine = F.array_distinct(stopped) if c == "stop" else by_status(active, entity, lambda e: e["status"], c)
            first = F.array_distinct(F.transform(active, entity)) if c == "new" else empty
            out = out.withColumn(f"{c}_symptoms", F.when(there & history, mine).when(there, first).otherwise(F.col(f"{c}_symptoms")))
    for told, own in (("answered_use", "patient_reported_current_use"), ("answered_discontinuation", "actual_discontinuation")):
        if told in out.columns:
            out = out.withColumn(own, F.coalesce(told, own)).drop(told)
    return out.drop("__past")


def with_stopped(rows: DataFrame) -> DataFrame:
    """actual_discontinuation with the medicines that recommendations stop, in order, and whats_changed filled from them where it is empty."""
    stops = F.transform(F.filter("deprescribing_recommendations", lambda r: (r["action"] == "stop") | r["status_change"].isin("resolved", "stop")), lambda r: r["medicine"])
    said = F.transform(F.slice("deprescribing_recommendations", 1, 4), lambda r: F.concat(r["action"], F.lit(" "), r["medicine"], F.lit(" for "), r["target_symptom"]))
    told = F.when(F.size(said) > 0, F.concat(F.lit("Medication actions recommended: "), F.array_join(said, ", "), F.lit("."))).otherwise(NO_CHANGES)
    return rows.withColumns({"actual_discontinuation": F.array_union("actual_discontinuation", stops), "whats_changed": F.when(F.coalesce(F.col("whats_changed") != "", F.lit(False)), F.col("whats_changed")).otherwise(told)})


def case_summary(rows: DataFrame, name: str = "clinical_summary") -> DataFrame:
    """A readable summary of an encounter: its header, complaints, diagnoses and notes.

    ``rows`` has visit_type, age, gender, symptoms, diagnoses, triaged_items and symptom_notes.
    """
    visit = F.lower(F.trim(F.coalesce("visit_type", F.lit(""))))
    whole = F.col("age") == F.floor("age")
    age = F.concat(F.lit("patient age: "), F.when(whole, F.col("age").cast("long").cast("string")).otherwise(F.col("age").cast("string")), F.lit(" yrs"))
    informant = F.get(F.filter("symptoms", lambda s: F.trim(s).rlike(r"(?i)^informant\b")), F.lit(0))
    head = F.array(F.when(visit.isin("follow-up", "follow_up", "followup"), "case type: follow up visit").otherwise("case type: new consultation"), F.when(F.col("age").isNotNull(), age), F.when(F.trim("gender") != "", F.concat(F.lit("patient gender: "), F.lower("gender"))), F.lower(F.trim(informant)))
    shown = F.transform("triaged_items", lambda i: F.when(i["category"] == "symptom", F.concat(F.lit("- "), i["raw_text"], F.when(F.coalesce(i["display_status"], F.lit("")) != "", F.concat(F.lit(" ("), i["display_status"], F.lit(")"))).otherwise(""))).when(i["category"] == "negated_symptom", F.concat(F.lit("- "), F.coalesce(i["canonical_entity"], i["raw_text"]), F.lit(" (resolved / denied)"))))
    present = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    complaints = F.when(F.size(present(shown)) > 0, present(shown)).otherwise(F.array(F.lit(NONE_ACTIVE)))
    from ..functions import text as X

    cleaned = F.filter(F.transform("diagnoses", lambda d: F.lower(X.clean_diagnosis(d))), lambda d: d != "")
    diagnoses = F.when(F.size("diagnoses") > 0, F.transform(cleaned, lambda d: F.concat(F.lit("- "), d))).otherwise(F.array(F.lit(NONE_RECORDED)))
    notes = F.when(F.coalesce("symptom_notes", F.lit("")) != "", F.array(F.lit(""), F.lit(NOTES_HEAD), F.col("symptom_notes"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(present(head), F.array(F.lit(""), F.lit(COMPLAINTS_HEAD)), complaints, F.array(F.lit(""), F.lit(DIAGNOSES_HEAD)), diagnoses, notes)
    return rows.withColumn(name, F.array_join(lines, "\n"))
