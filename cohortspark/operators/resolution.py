"""Resolution of free-text symptoms and diagnoses to ontology codes, with assertion, on distinct terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import context as C
from ..functions import text as X
from ..functions import triage as R
from ..session import sent, spread, written
from . import ontology as O

#: Leading words that assert, date or grade a finding and are no part of its name; the published NegEx and ConText triggers.
LEADING = r"(?i)^(?:\s*(?:no|not|denies|denied|denying|without|absence of|free of|negative for|ruled out|rules? out|never|nil|history of|h/o|past history of|previous(?:ly)?|prior|possible|possibly|probable|probably|suspected|query|may have|might have|likely|family history of|mother has|mother had|father has|father had|\?)\b?\s*)+"


def asserted(rows: DataFrame, term: str = "term") -> DataFrame:
    """Adds assertion_status, is_negated, is_phenotype and search_target.

    The search target is what a negated phrase denies, or the term without its
    leading modifiers; a deficit such as loss of appetite is searched as it is.
    """
    status = R.assertion_status(F.col(term))
    bare = F.trim(F.regexp_replace(F.col(term), LEADING, ""))
    target = F.when(F.col(term).rlike(R.DEFICIT), F.trim(term)).when(status == "negated", F.coalesce(R.negated_entity(F.col(term)), F.when(F.length(bare) >= 2, bare), F.trim(term)))
    target = target.otherwise(F.when(F.length(bare) >= 2, bare).otherwise(F.trim(term)))
    return rows.withColumns({"assertion_status": status, "is_negated": status == "negated", "is_phenotype": status == "affirmed", "search_target": target})


def entity_span(term: Column) -> Column:
    """The finding that a segment names, its modifiers trimmed; null if less than two characters are left."""
    bare = F.trim(F.regexp_replace(term, LEADING, ""))
    return F.when(F.length(bare) >= 2, bare)


def assertion_search(terms: DataFrame, entries: DataFrame, postings: DataFrame, k: int = 5, min_score: float = 0.0, filter_negated: bool = False, aliases: dict[str, str] | None = None) -> DataFrame:
    """Hits of each distinct term: term, rank, id, label, match_type, score, assertion_status and is_negated.

    The search target is looked up first, the term itself where that has no
    hit; ``filter_negated`` leaves out terms that are denied.
    """
    asked = written(asserted(terms.select("term").where(F.trim("term") != "").distinct()))
    asked = asked.where(~F.col("is_negated")) if filter_negated else asked
    kept = ["term", "assertion_status", "is_negated"]
    fields = ["rank", "id", "label", "match_type", "score"]
    wanted = asked.select(F.col("search_target").alias("term")).unionByName(asked.select("term")).distinct()
    hits = written(O.search(wanted, entries, postings, limit=k, min_score=min_score, aliases=aliases).select(F.col("term").alias("__asked"), *fields))
    by_target = asked.join(hits, F.col("search_target") == F.col("__asked")).select(*kept, *fields)
    rest = asked.join(by_target.select("term").distinct(), "term", "left_anti")
    by_term = rest.join(hits, F.col("term") == F.col("__asked")).select(*kept, *fields)
    return by_target.unionByName(by_term)


def resolved(terms: DataFrame, ontologies: dict[str, tuple[DataFrame, DataFrame]], policy: str = "strict", filter_negated: bool = False, aliases: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Distinct terms with, for each ontology name, <name>_label, <name>_id and <name>_score of the best hit, and their assertion.

    ``ontologies`` maps a name to (entries, postings).  ``strict`` abstains
    below the score limit and on definitions, ``lenient`` takes any best hit.
    """
    out = written(asserted(terms.select("term").where(F.trim("term") != "").distinct()))
    terms = out.select("term")
    for name, (entries, postings) in ontologies.items():
        best = assertion_search(terms, entries, postings, 1, filter_negated=filter_negated, aliases=(aliases or {}).get(name))
        best = best.where(O.accepted(F.col("match_type"), F.col("score"))) if policy == "strict" else best
        out = out.join(best.select("term", F.col("label").alias(f"{name}_label"), F.col("id").alias(f"{name}_id"), F.round("score", 4).alias(f"{name}_score")), "term", "left")
    return out


def matched(terms: DataFrame, ontologies: dict[str, tuple[DataFrame, DataFrame]], k: int = 5) -> DataFrame:
    """The best ``k`` hits of each term in every ontology, without abstaining: (ontology, term, rank, id, label, match_type, score)."""
    terms = written(terms.select("term").distinct())
    out = None
    for name, (entries, postings) in ontologies.items():
        part = assertion_search(terms, entries, postings, k).withColumn("ontology", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def note_segments(notes: DataFrame, keys: list[str], note: str = "note", normalize: bool = True) -> DataFrame:
    """(keys, pos, segment, assertion_status, is_pheno): a segment is a phenotype if it names a finding that is affirmed."""
    long = notes.select(*keys, F.posexplode(X.segment(F.col(note), normalize)).alias("pos", "segment"))
    status = R.assertion_status(F.col("segment"))
    return long.withColumns({"assertion_status": status, "is_pheno": (status == "affirmed") & entity_span(F.col("segment")).isNotNull()})


def note_findings(notes: DataFrame, keys: list[str], note: str = "note", normalize: bool = True) -> DataFrame:
    """(keys, pos, at, finding, assertion_status, is_pheno): the findings of each segment, each with the status that its scope gives it."""
    long = notes.select(*keys, F.posexplode(X.segment(F.col(note), normalize)).alias("pos", "segment"))
    each = long.select(*keys, "pos", F.posexplode(C.scoped_findings(F.col("segment"))).alias("at", "f"))
    return each.select(*keys, "pos", "at", "f.finding", F.col("f.status").alias("assertion_status"), (F.col("f.status") == "affirmed").alias("is_pheno"))


def processed_notes(notes: DataFrame, keys: list[str], entries: DataFrame, postings: DataFrame, embed: Callable[[str], Column] | None = None, note: str = "note", normalize: bool = True) -> DataFrame:
    """Segments of notes with is_pheno and, for phenotypes only, the vector and the code and id of the best hit.

    Every distinct phenotype is searched and embedded once.
    """
    segments = note_segments(notes, keys, note, normalize)
    terms = written(segments.where("is_pheno").select(F.col("segment").alias("term")).distinct())
    hits = O.search(terms, entries, postings, limit=1).select("term", F.col("id").alias("hpo_id"))
    vectors = terms.withColumn("embedding", embed("term")) if embed else terms.withColumn("embedding", F.lit(None).cast("array<float>"))
    known = terms.join(hits, "term", "left").join(vectors, "term").select(F.col("term").alias("segment"), "hpo_id", "embedding")
    joined = segments.join(known, "segment", "left")
    shown = lambda c: F.when(F.col("is_pheno"), F.col(c))
    return joined.select(*keys, "pos", "segment", "assertion_status", "is_pheno", shown("hpo_id").alias("hpo_id"), code_number(shown("hpo_id")).alias("hpo_code"), shown("embedding").alias("embedding"))


def code_number(curie: Column) -> Column:
    """The number of an identifier: 739 for HP:0000739."""
    return F.regexp_extract(curie, r"(\d+)", 1).try_cast("long")


def filled_codes(rows: DataFrame, entries: DataFrame, postings: DataFrame, prefix: str, term: str = "term", code: str = "code", curie: str = "curie") -> DataFrame:
    """``rows`` with code and curie where one was missing: from each other, or from the best hit of the term.

    What is given stays; only rows that have neither are searched.
    """
    missing = rows.where(F.col(code).isNull() & F.col(curie).isNull() & (F.trim(F.coalesce(term, F.lit(""))) != "")).select(F.col(term).alias("term")).distinct()
    found = O.search(missing, entries, postings, limit=1).select(F.col("term").alias("__term"), F.col("id").alias("__id"))
    joined = rows.join(found, F.col(term) == F.col("__term"), "left")
    none = F.col(code).isNull() & F.col(curie).isNull()
    given = F.coalesce(F.col(curie), X.to_curie(prefix, F.col(code)), F.when(none, X.to_curie(prefix, F.col("__id"))))
    return joined.withColumns({"__curie": given, "__code": F.coalesce(F.col(code).cast("long"), code_number(given))}).drop(code, curie, "__term", "__id").withColumnsRenamed({"__curie": curie, "__code": code})


def decorate_cases(cases: DataFrame, keys: list[str], hpo: tuple[DataFrame, DataFrame], mondo: tuple[DataFrame, DataFrame], embed: Callable[[str], Column] | None = None, symptoms: str = "symptoms", diagnoses: str = "diagnosis", policy: str = "strict") -> DataFrame:
    """``cases`` with arrays of strings turned into arrays of structs: term, label, code, embedding and assertion flags, in order.

    Symptoms are resolved in one ontology, diagnoses, cleaned first, in the
    other; terms that are repeated stay repeated; every distinct term is
    found, resolved and embedded once.
    """
    # a small file is one task; dealt out by their keys, cases gather what they hold without being shuffled again
    out = cases = spread(cases, *keys)
    for column, name, pair, clean in ((symptoms, "hpo", hpo, lambda t: F.trim(t)), (diagnoses, "mondo", mondo, X.clean_diagnosis)):
        listed = F.filter(F.transform(F.coalesce(column, F.array().cast("array<string>")), clean), lambda x: x.isNotNull() & (x != ""))
        long = cases.select(*keys, F.posexplode(listed).alias("pos", "term"))
        known = resolved(long, {name: pair}, policy)
        vectors = sent(written(known.withColumn("embedding", embed("term") if embed else F.lit(None).cast("array<float>"))))
        packed = F.struct("pos", "term", F.col(f"{name}_label").alias("label"), F.col(f"{name}_id").alias("code"), "embedding", "is_negated", F.col("is_phenotype").alias("is_pheno"))
        arrays = long.join(vectors, "term").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(packed)), lambda s: s.dropFields("pos")).alias("__found"))
        empty = F.array().cast(arrays.schema["__found"].dataType)
        out = out.join(arrays, keys, "left").withColumn(column, F.coalesce("__found", empty)).drop("__found")
    return out


def presenting(symptoms: Column) -> Column:
    """The decorated symptoms that a patient has: phenotypes that are not denied."""
    return F.filter(symptoms, lambda s: s["is_pheno"] & ~s["is_negated"])


def pertinent_negatives(symptoms: Column) -> Column:
    """The decorated symptoms that a patient denies."""
    return F.filter(symptoms, lambda s: s["is_negated"])
