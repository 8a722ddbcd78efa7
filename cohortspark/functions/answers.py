"""Contracts of model answers: each function reads one kind of answer text into a struct; what is missing is null or empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .triage import bound, json_answer

NAMES = "array<string>"

# The fields of the contracts.
ITEM = "raw_text string, complaint string, category string, canonical_entity string, status string, change_description string, notes string"
RECOMMENDATION = "medicine string, drug string, target_symptom string, symptom string, status_change string, status string, action string, rationale string, taper_plan string"
MEDICINE = "brand_name string, canonical_molecule string, is_fdc string, dosage_group_id string, release_form string, dosage_tier string, dose string, frequency string, duration string, rationale string"


def _get(answer: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(answer, f"$.{path}", kind)


def _text(answer: Column, path: str) -> Column:
    return F.trim(F.coalesce(_get(answer, path, "string"), F.lit("")))


def _said(answer: Column, path: str) -> Column:
    """The text under ``path``; null if it is missing or blank."""
    return bound(_text(answer, path), lambda t: F.when(t != "", t))


def _filled(first: Column, *others: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(bound(F.trim(c), lambda t: F.when(t != "", t)) for c in (first, *others)))


def _names(answer: Column, path: str) -> Column:
    """A list of texts, trimmed, blank ones dropped; a single text counts as a list of one; an empty list otherwise."""
    plain = lambda single: F.when(~F.coalesce(single.startswith("["), F.lit(False)) & ~F.coalesce(single.startswith("{"), F.lit(False)), F.array(single))
    listed = F.coalesce(_get(answer, path, NAMES), bound(_get(answer, path, "string"), plain))
    return F.coalesce(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast(NAMES))


def _listed(answer: Column, paths: tuple[str, ...], fields: str) -> Column:
    """The first list of objects under ``paths`` that is there and not empty."""
    kind = f"array<struct<{fields.replace(' string', ':string')}>>"
    found = [bound(_get(answer, p, kind), lambda rows: F.when(F.size(rows) > 0, rows)) for p in paths]
    return F.coalesce(*found, F.array().cast(kind))


def recommendations(answer: Column) -> Column:
    """Deprescribing recommendations under any of their names, with defaults for what is missing."""
    rows = _listed(answer, ("deprescribing_recommendations", "recommendations", "actions"), RECOMMENDATION)
    return F.transform(
        rows,
        lambda r: F.struct(
            F.coalesce(_filled(r["medicine"], r["drug"]), F.lit("Unknown")).alias("medicine"),
            F.coalesce(_filled(r["target_symptom"], r["symptom"]), F.lit("General presentation")).alias("target_symptom"),
            F.coalesce(_filled(r["status_change"], r["status"]), F.lit("maintained")).alias("status_change"),
            F.coalesce(_filled(r["action"]), F.lit("maintained")).alias("action"),
            F.coalesce(r["rationale"], F.lit("")).alias("rationale"),
            r["taper_plan"].alias("taper_plan"),
        ),
    )


def triage_answer(text: Column) -> Column:
    """The triage and deprescribing contract; null if the text holds no JSON object."""
    return bound(json_answer(text), _triage)


def _triage(a: Column) -> Column:
    items = F.filter(
        F.transform(_listed(a, ("triaged_items", "symptoms"), ITEM), lambda i: F.struct(_filled(i["raw_text"], i["complaint"]).alias("name"), *(i[c].alias(c) for c in ("category", "canonical_entity", "status", "change_description", "notes")))),
        lambda i: i["name"].isNotNull(),
    )
    changed = F.coalesce(*(_said(a, p) for p in ("whats_changed", "summary", "clinical_summary")), F.lit(""))
    lists = ("patient_reported_current_use", "actual_discontinuation", "historical_prescription", "latest_documented_prescription")
    return F.when(
        a.isNotNull(),
        F.struct(
            _text(a, "patient_condition").alias("patient_condition"),
            _text(a, "symptom_notes").alias("symptom_notes"),
            changed.alias("whats_changed"),
            items.alias("triaged_items"),
            recommendations(a).alias("deprescribing_recommendations"),
            *(_names(a, p).alias(p) for p in lists),
        ),
    )


def med_check_answer(text: Column) -> Column:
    """The medication check contract: whats_changed, checks (entity, attributed_molecules, recommended_top_molecules) and summary."""
    return bound(json_answer(text), _med_check)


def _med_check(a: Column) -> Column:
    named = "array<struct<entity:string,attributed_molecules:array<string>,recommended_top_molecules:array<variant>>>"
    rows = F.coalesce(*(bound(_get(a, p, named), lambda rows: F.when(F.size(rows) > 0, rows)) for p in ("entity_medication_check", "entity_checks")), F.array().cast(named))
    molecule = lambda v: _filled(F.try_variant_get(v, "$.canonical_molecule", "string"), F.try_variant_get(v, "$.name", "string"), F.when(~F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "string")))
    present = lambda xs: F.coalesce(F.filter(xs, lambda x: x.isNotNull() & (x != "")), F.array().cast(NAMES))
    checks = F.filter(
        F.transform(rows, lambda r: F.struct(F.trim(r["entity"]).alias("entity"), present(r["attributed_molecules"]).alias("attributed_molecules"), present(F.transform(r["recommended_top_molecules"], molecule)).alias("recommended_top_molecules"))),
        lambda r: F.coalesce(r["entity"] != "", F.lit(False)),
    )
    return F.when(a.isNotNull(), F.struct(F.coalesce(_said(a, "whats_changed"), _text(a, "summary")).alias("whats_changed"), checks.alias("checks"), _text(a, "summary").alias("summary")))


def prescription_answer(text: Column) -> Column:
    """The prescribing contracts, both forms: medications, recommendations, explanation, confidence_score, missing_information and chain_of_thought.

    Medications are taken from ``medications`` or, if that is empty, from
    ``recommended_medications``, whose entries may wrap the medicine; plain
    names count as brands.  A text that is no JSON gives the brand names that
    can be read from it, and its explanation or itself as explanation.
    """
    return bound(json_answer(text), lambda a: _prescription(a, text))


def _prescription(a: Column, text: Column) -> Column:
    kind = f"struct<{MEDICINE.replace(' string', ':string')}>"

    def listed(variant: Column, wrapped: bool) -> Column:
        def medicine(v: Column) -> Column:
            inner = F.coalesce(F.try_variant_get(v, "$.medication_master_item", "variant"), F.try_variant_get(v, "$.medication", "variant"), v) if wrapped else v
            whole = F.when(F.schema_of_variant(inner).startswith("OBJECT"), F.try_variant_get(inner, "$", kind))
            name = F.when(~F.schema_of_variant(inner).startswith("OBJECT"), F.trim(F.try_variant_get(inner, "$", "string")))
            fields = [f.strip().split()[0] for f in MEDICINE.split(",")]
            plain = F.struct(*(name.alias(f) if f == "brand_name" else F.lit(None).cast("string").alias(f) for f in fields))
            return F.coalesce(whole, F.when(name != "", plain))

        many = F.try_variant_get(variant, "$", "array<variant>")
        one = F.when(F.schema_of_variant(variant) == "STRING", F.array(variant))
        return F.filter(F.transform(F.coalesce(many, one), medicine), lambda m: m.isNotNull())

    first = listed(_get(a, "medications", "variant"), False)
    second = listed(_get(a, "recommended_medications", "variant"), True)
    bare = listed(F.when(F.schema_of_variant(a).startswith("ARRAY"), a), False)
    whole = F.coalesce(*(bound(c, lambda rows: F.when(F.size(rows) > 0, rows)) for c in (first, second, bare)))
    brands = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r'"brand_name"\s*:\s*"([^"]+)"'), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    quoted = F.split(F.regexp_extract(text, r'(?s)"medications"\s*:\s*\[(.*?)\]', 1), ",")
    names = F.filter(F.transform(quoted, lambda x: F.trim(x, F.lit(" \t\r\n\"'"))), lambda x: x != "")
    fields = [f.strip().split()[0] for f in MEDICINE.split(",")]
    salvaged = F.transform(F.when(F.size(brands) > 0, brands).otherwise(names), lambda n: F.struct(*(n.alias(f) if f == "brand_name" else F.lit(None).cast("string").alias(f) for f in fields)))
    said = F.regexp_extract(text, r'(?s)"explanation"\s*:\s*"([^"\\]*(?:\\.[^"\\]*)*)"', 1)
    none = F.array().cast(f"array<{kind}>")
    parsed = a.isNotNull()
    return F.when(
        text.isNotNull(),
        F.struct(
            F.coalesce(F.when(parsed, whole).otherwise(salvaged), none).alias("medications"),
            F.when(parsed, recommendations(a)).alias("deprescribing_recommendations"),
            F.when(parsed, _text(a, "explanation")).when(said != "", said).otherwise(F.trim(text)).alias("explanation"),
            _get(a, "confidence_score", "double").alias("confidence_score"),
            _names(a, "missing_information").alias("missing_information"),
            _text(a, "chain_of_thought").alias("chain_of_thought"),
            parsed.alias("parsed"),
        ),
    )


def search_queries_answer(text: Column, symptoms: Column, diagnoses: Column) -> Column:
    """The search query contract: vector_semantic_queries and bm25_keywords; without a JSON object, both made from the terms."""
    a = json_answer(text)
    s, d = (F.filter(F.coalesce(c, F.array().cast(NAMES)), lambda x: F.coalesce(x != "", F.lit(False))) for c in (symptoms, diagnoses))
    about = F.coalesce(F.get(d, F.lit(0)), F.get(s, F.lit(0)), F.lit("Clinical condition"))
    some = (F.size(s) > 0) | (F.size(d) > 0)
    sentence = F.when(some, F.concat(F.lit("Pharmacotherapy and clinical dosing indication for "), about, F.lit(" with "), F.array_join(F.slice(s, 1, 3), ", "), F.lit("."))).otherwise("Pharmacotherapy for general clinical presentation.")
    words = F.array_sort(F.array_distinct(F.concat(d, s)))
    parsed = F.coalesce(F.schema_of_variant(a).startswith("OBJECT"), F.lit(False))
    return F.struct(
        F.when(parsed, _names(a, "vector_semantic_queries")).otherwise(F.array(sentence)).alias("vector_semantic_queries"),
        F.when(parsed, _names(a, "bm25_keywords")).otherwise(F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("Medication")))).alias("bm25_keywords"),
    )


# Phrases of a prompt and the call that it belongs to, in order of precedence.
CALL_NAMES = (
    (("step 2: fill clinical gaps",), "step2_fill_gap_prescription"),
    (("senior consultant indian psychiatrist",), "step1_psychiatrist_prescription"),
    (("evaluating changes in patient symptoms and intake items", "clinical context"), "triage_symptom_changes"),
    (("deprescrib",), "deprescribing_review"),
    (("active medication search", "patient clinical presentation"), "medication_search_queries"),
)


def call_name(prompt: Column) -> Column:
    """The name of a call by what its prompt says; llm_generation where nothing is known."""
    low = F.lower(F.coalesce(prompt, F.lit("")))
    out = F.lit("llm_generation")
    for phrases, name in reversed(CALL_NAMES):
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | low.contains(phrase)
        out = F.when(hit, name).otherwise(out)
    return out
