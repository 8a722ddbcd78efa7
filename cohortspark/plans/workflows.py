"""Composite operations: ingestion, similar cases, entity matrices, prescribing context and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import triage as R
from ..operators import delta as D
from ..operators import encounters as E
from ..operators import evaluation as A
from ..operators import medicines as M
from ..operators import ontology as O
from ..operators import ranking as K
from ..operators import upsert as U
from ..session import sent, spread, written


def decorate_terms(rows: DataFrame, keys: list[str], text: str, split: Callable[[Column], Column], resolver: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """(keys, name): an array of structs in the text's order, repeated terms kept, each with what ``resolver`` says of its term.

    Every distinct term is resolved once: ``resolver`` takes a table of
    distinct terms (column term) and returns one row a term that it knows.
    """
    listed = lambda r: r.select(*keys, F.posexplode(split(F.col(text))).alias("pos", "term"))
    # every step of the resolver reads them, and would find them in the whole table again
    terms = written(listed(rows).select("term").distinct())
    known = resolver(terms)
    fields = [c for c in known.columns if c != "term"]
    flags = R.assertion_status(F.col("term"))
    told = sent(written(terms.join(known, "term", "left").withColumn("is_negated", flags == "negated")))
    # a term that is null, of which nothing is known, denies nothing
    # rows are dealt out by their keys while each is one row, so that its terms need not be shuffled to come together
    joined = listed(spread(rows.select(*keys, text), *keys)).join(told, "term", "left").withColumn("is_negated", F.coalesce("is_negated", F.lit(False)))
    packed = F.array_sort(F.collect_list(F.struct("pos", "term", *fields, "is_negated")))
    return joined.groupBy(*keys).agg(packed.alias(name))


def ontology_resolver(entries: DataFrame, postings: DataFrame, policy: str = "lenient", aliases: dict[str, str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Best hit of each term: label and curie; assertion-aware, so a denied term is looked up by what it denies."""

    def resolve(terms: DataFrame) -> DataFrame:
        target = F.when(R.assertion_status(F.col("term")) == "negated", F.coalesce(R.negated_entity(F.col("term")), "term")).otherwise(F.col("term"))
        asked = terms.select("term", target.alias("__target"))
        hits = O.resolve(asked.select(F.col("__target").alias("term")), entries, postings, policy, aliases=aliases)
        return asked.join(hits.select(F.col("term").alias("__target"), "label", F.col("id").alias("curie"), "score"), "__target").drop("__target")

    return resolve


def medicine_resolver(master: DataFrame, fields: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Master fields of each medicine term; combinations also as ``molecules``, the list of their parts."""
    return lambda terms: M.match_medicines(terms, master).select("term", *fields, M.molecules_of(F.col("canonical_molecule")).alias("molecules"))


def migrate(sources: dict[str, DataFrame], table: DataFrame | None, resolvers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The case table's next state: assembled encounters, decorated, upserted by case and visit date.

    ``sources`` has visits, patients, complaints, diagnoses, prescriptions and
    optionally investigations; ``resolvers`` symptoms, diagnosis and medications.
    """
    keys = ["case_no", "visit_date"]
    unified = E.assemble(*(sources[k] for k in ("visits", "patients", "complaints", "diagnoses", "prescriptions")), sources.get("investigations"))
    cases = written(U.last_per_key(unified, keys))
    parts = (("symptoms", "chief_complaints", X.complaint_terms), ("diagnosis", "diagnosis_names", X.comma_terms), ("medications", "medicine_names", X.comma_terms))
    out = spread(cases, *keys)
    for name, column, split in parts:
        out = out.join(decorate_terms(cases, keys, column, split, resolvers[name], name), keys, "left")
    return out if table is None else U.upsert(table, out, keys)


def entity_matrix(entities: DataFrame, pairs: DataFrame, cases: DataFrame, medicines: DataFrame, by: list[str], k: int = 5, limit: int = 20, min_similarity: float = 0.5, age: Column | None = None) -> DataFrame:
    """``entities`` with an array of their top molecules, all ranked in one job; an empty array marks a gap."""
    ranked = K.rank_medicines(pairs, cases, medicines, by, k, limit, min_similarity, age)
    rows = ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "molecule"))), lambda x: x["molecule"]).alias("molecules"))
    return entities.join(rows, by, "left").withColumn("molecules", F.coalesce("molecules", F.array().cast("array<string>")))


def encounter_context(encounters: DataFrame) -> DataFrame:
    """Encounters (case_no, visit_date, symptoms, diagnoses, medications as arrays) with what changed since their case's past, and a summary.

    Past medicines are given apart: all of them in order, and those of the
    latest visit.
    """
    from pyspark.sql import Window

    past = Window.partitionBy("case_no").orderBy("visit_date").rowsBetween(Window.unboundedPreceding, -1)
    rows = E.histories(encounters, {"past_symptoms": "symptoms", "past_diagnoses": "diagnoses", "historical_prescription": "medications"}, ["visit_date"])
    rows = rows.withColumn("latest_documented_prescription", F.last("medications", ignorenulls=True).over(past))
    return D.summary_text(D.encounter_delta(rows))


def check_medications(matrix: DataFrame, answers: DataFrame) -> DataFrame:
    """A matrix with its gaps filled from model answers (entity, answer text) under ``entity_medication_check``."""
    spec = "array<struct<entity string, attributed_molecules array<string>, recommended_top_molecules array<string>>>"
    checks = answers.select(F.explode(F.try_variant_get(R.json_answer(F.col("answer")), "$.entity_medication_check", spec)).alias("c"))
    found = checks.select("c.entity", F.concat(F.coalesce("c.attributed_molecules", F.array().cast("array<string>")), F.coalesce("c.recommended_top_molecules", F.array().cast("array<string>"))).alias("molecules"))
    return K.merged_checks(matrix, found)


def accuracy_report(records: DataFrame, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, cohort summary, confusion) of result records with expectedMeds, res.medications and cohort columns, matched by ``mode``."""
    tokens = lambda meds: F.flatten(F.transform(F.coalesce(meds, F.array()), lambda m: X.component_tokens(m["brand_name"], m["canonical_molecule"], m["constituent_strengths_mg"], mode)))
    rows = records.withColumns({"expected": tokens(F.col("expectedMeds")), "predicted": tokens(F.col("res.medications"))})
    cases = rows.withColumns(A.case_evaluation(F.col("expected"), F.col("predicted")))
    return cases, A.cohort_summary(cases), A.confusion(cases)


def offline_answer(prompt: Column) -> Column:
    """A stand-in for a language model: an answer in the form that the parsers read, by what the prompt asks for."""
    field = lambda name: F.trim(F.regexp_extract(prompt, rf"- {name}:[ \t]*([^\n]*)", 1))
    symptoms, disease = field("Symptoms"), field("Diagnosis")
    given = lambda c, none: F.when((c != "") & (c != none), c)
    s, d = given(symptoms, "None reported"), given(disease, "None specified")
    query = F.concat(F.lit("Clinical dosing indication for management of "), F.coalesce(d, F.lit("clinical condition")), F.coalesce(F.concat(F.lit(" with "), s), F.lit("")), F.lit("."))
    words = F.array_distinct(F.concat(F.coalesce(F.array(d), F.array().cast("array<string>")), X.comma_terms(s), F.array(F.lit("Pharmacotherapy"))))
    search = F.to_json(F.struct(F.array(query).alias("vector_semantic_queries"), F.filter(words, lambda w: w.isNotNull()).alias("bm25_keywords")))
    review = F.lit('{"whats_changed": "not assessed offline", "deprescribing_recommendations": [], "triaged_items": []}')
    plain = F.concat(F.lit('```json\n{"patient_condition": "not assessed", "entity_medication_check": [], "medications": [], "explanation": "offline answer to a prompt of '), F.length(prompt).cast("string"), F.lit(' characters"}\n```'))
    low = F.lower(prompt)
    return F.when(low.contains("vector_semantic_queries") | low.contains("bm25_keywords"), search).when(low.contains("deprescrib"), review).otherwise(plain)


def call_log(prompts: DataFrame, family: str, model: Callable[[Column], Column] = offline_answer) -> DataFrame:
    """Prompts (prompt, and call_name where it is known) with answers, sizes and cost: the table that replaces trace files."""
    from ..functions.answers import call_name
    from ..functions.vectors import call_cost

    named = F.coalesce("call_name", call_name(F.col("prompt"))) if "call_name" in prompts.columns else call_name(F.col("prompt"))
    answered = prompts.withColumn("call_name", named).withColumn("answer", model(F.col("prompt"))).withColumns({"tokens_in": F.ceil(F.length("prompt") / 4), "tokens_out": F.ceil(F.length("answer") / 4)})
    return answered.withColumn("cost", call_cost(F.lit(family), F.col("tokens_in"), F.col("tokens_out")))


def matrix_text(matrix: DataFrame, entity: str = "entity") -> DataFrame:
    """One markdown row an entity: | entity | molecules |."""
    return matrix.select(entity, F.concat(F.lit("| "), F.col(entity), F.lit(" | "), F.when(F.size("molecules") > 0, F.array_join("molecules", ", ")).otherwise("none found"), F.lit(" |")).alias("row"))
