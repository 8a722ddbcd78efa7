"""Composite operations that start from entities: similar cases, rankings, the steps of prescribing, and ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as N
from ..functions import dates as T
from ..operators import assessment as A
from ..operators import delta as D
from ..operators import medicines as M
from ..operators import pairs as P
from ..operators import ranking as K
from ..operators import similarity as S

NAMES = "array<string>"

# Sentences of the reports.
NO_GAPS = "All clinical entities have existing candidate medication matches; no missing medications required from formulary."
REFUSED = "At least 1 symptom and 1 diagnosis is required."


def _similarity(queries: DataFrame, cases: DataFrame, case_entities: DataFrame, closure: DataFrame | None, **options) -> DataFrame:
    """(case_id, set_similarity): null for cases without entities or an empty query set, 0 where nothing is alike."""
    found = P.set_similarities(queries.withColumn("__q", F.lit(0)), case_entities, ["__q"], ["case_id"], closure, **options).drop("__q")
    asked = queries.limit(1).select(F.lit(0.0).alias("__zero"))
    there = case_entities.select("case_id").distinct().crossJoin(F.broadcast(asked))  # at most one row
    return there.join(found, "case_id", "left").select("case_id", F.coalesce("set_similarity", "__zero").alias("set_similarity"))


def similar_cases(query: dict, symptoms: DataFrame, diagnoses: DataFrame, cases: DataFrame, case_symptoms: DataFrame, case_diagnoses: DataFrame, k: int, hpo: DataFrame | None = None, mondo: DataFrame | None = None, weights: dict[str, float] = S.WEIGHTS, **options) -> DataFrame:
    """The cases most like one encounter, ranked and capped, from entities alone.

    ``symptoms`` and ``diagnoses`` are the encounter's (term, code, embedding),
    the case tables ``pairs.entities`` under case_id; ``hpo`` and ``mondo`` are
    closures of their taxonomies.
    """
    return S.similar_cases(query, cases, _similarity(symptoms, cases, case_symptoms, hpo, **options), _similarity(diagnoses, cases, case_diagnoses, mondo, **options), k, weights)


def rank_medicines(queries: DataFrame, case_entities: DataFrame, cases: DataFrame, medicines: DataFrame, by: list[str], closure: DataFrame | None = None, generic_depth: int = 2, **options) -> DataFrame:
    """Molecules for every query entity at once, from the entities of the candidate cases.

    The age predicate, where an age is given, is applied to cases before their
    entities are met.
    """
    age = options.get("age")
    fitting = cases if age is None else cases.where(K.V.ages_compatible(age, F.col("age")))
    held = case_entities.join(fitting.select("case_id"), "case_id", "left_semi")
    return K.rank_medicines(P.evidence(queries, held, by, ["case_id"], closure, generic_depth), cases, medicines, by, **options)


def frequency_matrix(queries: DataFrame, case_entities: DataFrame, medicines: DataFrame, by: list[str], closure: DataFrame | None = None, k: int = 5, **options) -> DataFrame:
    """The older matrix: molecules of the ``k`` cases most like each single entity, every mention counted, most frequent first.

    Scores that agree in nine digits are ties, which go to the smaller case_id.
    """
    scored = P.set_similarities(queries, case_entities, by, ["case_id"], closure, **options).withColumnRenamed("set_similarity", "case_score")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.round("case_score", 9).desc(), "case_id"))
    top = scored.where("case_score > 0").withColumn("place", place).where(F.col("place") <= k)
    usage = K.molecule_usage(top, medicines, by, once_per_case=False)
    order = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("frequency"), F.desc("avg_similarity"), "molecule"))
    return usage.withColumn("rank", order)


def stamped(matrix: DataFrame, delta: DataFrame, keys: list[str], term: str = "entity", past: str = "past_terms") -> DataFrame:
    """Matrix rows with delta_status, each term looked up in its encounter's delta."""
    lists = list(D.STATUSES)
    joined = matrix.join(delta.select(*keys, *lists, *([past] if past in delta.columns else [])), keys, "left")
    known = F.coalesce(F.col(past), F.array().cast(NAMES)) if past in joined.columns else F.array().cast(NAMES)
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(NAMES)).alias(c)
    filled = joined.select(*matrix.columns, *(empty(c) for c in lists), known.alias("__known"))
    return filled.withColumn("delta_status", D.delta_status(F.col(term), F.col("__known"))).select(*matrix.columns, "delta_status")


def deprescribe_step(encounters: DataFrame, answer: str | None = None) -> DataFrame:
    """Encounters assessed: triaged items, delta, recommendations, what changed and a summary.

    ``encounters`` has symptoms, diagnoses, past_symptoms and past_diagnoses
    (arrays), age, gender and visit_type, and the model's ``answer``, if there
    is one.
    """
    marked = A.keyword_marks(encounters)
    out = A.case_summary(A.with_stopped(A.assessed_delta(A.assessed(marked, answer))))
    return out.withColumn("triage_delta", A.triage_report(F.col("triaged_items"))).drop("marks")


def gaps(matrix: DataFrame) -> DataFrame:
    """Matrix rows without a molecule."""
    return matrix.where(F.size("molecules") == 0)


def med_check_step(matrix: DataFrame, answers: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(matrix, report): gaps filled from an answer's checks, and per encounter the filled entities and what changed.

    ``answers`` has the keys and answer, one row an encounter; encounters
    without gaps ask for none and say so.
    """
    keys = keys or []
    read = answers.select(*keys, N.med_check_answer(F.col("answer")).alias("a"))
    checks = read.select(*keys, F.explode("a.checks").alias("c"))
    asked = checks.select(*keys, F.lower(F.trim("c.entity")).alias("__e"), F.concat("c.attributed_molecules", "c.recommended_top_molecules").alias("m"))
    more = asked.groupBy(*keys, "__e").agg(F.array_distinct(F.flatten(F.collect_list("m"))).alias("__more"))
    joined = matrix.withColumn("__e", F.lower(F.trim("entity"))).join(more, [*keys, "__e"], "left").drop("__e")
    known = F.transform("molecules", F.lower)
    fresh = F.filter(F.coalesce("__more", F.array().cast(NAMES)), lambda x: ~F.array_contains(known, F.lower(x)))
    filled = joined.withColumn("molecules", F.concat("molecules", fresh)).drop("__more")
    holes = F.array_sort(F.collect_list(F.when(F.size("molecules") == 0, F.col("entity"))))
    per = (matrix.groupBy(*keys) if keys else matrix).agg(holes.alias("filled_entities"))
    said = read.select(*keys, F.col("a.whats_changed").alias("__said"))
    report = per.join(said, keys, "left") if keys else per.crossJoin(said)  # one row
    none = F.lit(NO_GAPS)
    told = F.when(F.size("filled_entities") == 0, none).when(F.coalesce(F.col("__said") != "", F.lit(False)), F.col("__said"))
    counted = F.concat(F.lit("Assigned candidate formulary medications for "), F.size("filled_entities").cast("string"), F.lit(" gap entities: "), F.array_join("filled_entities", ", "), F.lit("."))
    return filled, report.withColumn("whats_changed", F.coalesce(told, counted)).drop("__said")


def prescribe_step(answers: DataFrame, keys: list[str], master: DataFrame, fields: list[str]) -> DataFrame:
    """(keys, pos, medicine fields, explanation): what an answer prescribes, filled in from the medicine master."""
    read = answers.select(*keys, N.prescription_answer(F.col("answer")).alias("a"))
    rows = read.select(*keys, F.col("a.explanation").alias("explanation"), F.posexplode("a.medications").alias("pos", "m"))
    wanted = [c for c in ("brand_name", "canonical_molecule", "is_fdc", "dosage_group_id", "release_form", "dosage_tier")]
    return M.prescribed(rows.select(*keys, "pos", "explanation", *(F.col(f"m.{c}").alias(c) for c in wanted)), master, fields)


def history_text(encounters: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """(keys, history): a numbered line a visit, oldest first: when it was, complaints, diagnoses and medicines.

    ``encounters`` has visit_date, symptoms, diagnoses and medications.
    """
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("none"))
    when = F.concat(F.col("visit_date").cast("string"), F.lit(" ("), T.relative_time(F.col("visit_date"), now), F.lit(")"))
    line = F.concat_ws("; ", when, part("complaints", "symptoms"), part("diagnoses", "diagnoses"), part("medicines", "medications"))
    rows = encounters.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("visit_date", line.alias("line")))).alias("v"))
    numbered = F.transform("v", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"]))
    return rows.select(*keys, F.array_join(numbered, "\n").alias("history"))


def prescription_prompts(encounters: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, call_name, prompt): the summary of each encounter followed by its matrix as a table."""
    cells = F.when(F.size("molecules") > 0, F.array_join("molecules", ", ")).otherwise("none found")
    row = F.concat(F.lit("| "), F.col("entity"), F.lit(" | "), cells, F.lit(" |"))
    table = matrix.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("__table"))
    head = F.lit("| entity | molecules |\n| --- | --- |\n")
    joined = encounters.join(table, keys, "left")
    return joined.select(*keys, F.lit("llm_med_prescribe").alias("call_name"), F.concat(F.col("clinical_summary"), F.lit("\n\n"), head, F.coalesce("__table", F.lit(""))).alias("prompt"))


def search_query_prompts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, symptoms, diagnoses, prompt): what a model is asked for medication search queries."""
    listed = lambda c, none: F.when(F.size(F.coalesce(c, F.array().cast(NAMES))) > 0, F.array_join(c, ", ")).otherwise(none)
    prompt = F.concat(F.lit("Active medication search: answer as JSON with vector_semantic_queries and bm25_keywords.\n\nPATIENT CLINICAL PRESENTATION:\n- Symptoms: "), listed("symptoms", "None reported"), F.lit("\n- Diagnosis: "), listed("diagnoses", "None specified"), F.lit("\n"))
    return rows.select(*keys, "symptoms", "diagnoses", prompt.alias("prompt"))


def search_queries(rows: DataFrame, keys: list[str], model: Callable[[Column], Column]) -> DataFrame:
    """(keys, vector_semantic_queries, bm25_keywords) of a model's answers, made from the terms where it gives none."""
    asked = search_query_prompts(rows, keys).withColumn("answer", model(F.col("prompt")))
    return asked.select(*keys, N.search_queries_answer(F.col("answer"), F.col("symptoms"), F.col("diagnoses")).alias("q")).select(*keys, "q.*")


def prescribe_v1(requests: DataFrame, history: DataFrame, similar: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """The one-step form: per request the medicines that a model answers, and how many past and similar cases it was shown.

    ``requests`` has request_id, symptoms and diagnoses; ``history`` and
    ``similar`` request_id and a text a case.  Requests without a symptom and a
    diagnosis are refused: error says so, and no model is asked.
    """
    blank = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast(NAMES)), lambda x: F.trim(x) != "")) == 0
    checked = requests.withColumn("error", F.when(blank("symptoms") | blank("diagnoses"), REFUSED))
    gathered = lambda df, name: df.groupBy("request_id").agg(F.count("*").alias(f"{name}_count"), F.array_join(F.array_sort(F.collect_list("text")), "\n").alias(f"__{name}"))
    rows = checked.join(gathered(history, "past"), "request_id", "left").join(gathered(similar, "similar"), "request_id", "left")
    text = lambda c: F.coalesce(c, F.lit("none"))
    prompt = F.concat(F.lit("Symptoms: "), F.array_join("symptoms", ", "), F.lit("\nDiagnoses: "), F.array_join("diagnoses", ", "), F.lit("\nPast cases:\n"), text("__past"), F.lit("\nSimilar cases:\n"), text("__similar"))
    rows = rows.withColumn("prompt", F.when(F.col("error").isNull(), prompt))
    answered = rows.withColumn("a", F.when(F.col("prompt").isNotNull(), N.prescription_answer(model(F.col("prompt")))))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return answered.select("request_id", "error", n("past_count"), n("similar_count"), F.col("a.medications").alias("medications"), F.col("a.explanation").alias("explanation"), "prompt")


def training_cases(records: DataFrame, embed: Callable[[str], Column], limit: int = 5, note: str = "clinical_note", condition: str = "suspected_condition") -> DataFrame:
    """Case rows of the first records by id: one symptom from the note's first 60 characters and one diagnosis, each with its vector."""
    rows = records.orderBy("id").limit(limit)
    rows = rows.withColumns({"__s": F.substring(F.coalesce(note, F.lit("Unspecified symptoms")), 1, 60), "__d": F.coalesce(condition, F.lit("Unspecified diagnosis"))})
    vectors = rows.withColumns({"__sv": embed("__s"), "__dv": embed("__d")})
    entity = lambda t, v: F.array(F.struct(F.col(t).alias("text"), F.col(v).alias("embedding")))
    return vectors.select(F.uuid().alias("_id"), F.col("id").alias("case_no"), F.substring(F.col("created_at").cast("string"), 1, 10).alias("visit_date"), F.col("patient_id").alias("name"), entity("__s", "__sv").alias("symptoms"), entity("__d", "__dv").alias("diagnosis"))
