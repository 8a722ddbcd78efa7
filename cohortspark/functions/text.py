"""Text functions: Column in, Column out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks that stay at the head of a line.
KEPT_MARKS = r"%+/?\-().,:;"
DOSE_FORMS = r"(?i)\b(tab|cap|inj|syp|tablet|capsule|syrup|injection)\b\.?"
STRENGTH = r"(?i)\b\d+\s*(mg|ml|mcg|g)\b"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition.  There is no built-in; ASCII text, which it leaves alone, is handed over as null and taken as it is."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, text).otherwise(_nfkc(F.when(~plain, text)))


def strip_leading_marks(text: Column) -> Column:
    """One line without leading white space, symbols and punctuation (but the marks kept) and trailing white space."""
    head = rf"^(?:\s|(?![{KEPT_MARKS}])[\p{{S}}\p{{P}}])+"
    return F.regexp_replace(F.regexp_replace(text, head, ""), r"\s+$", "")


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")


def sanitize(text: Column, normalize: bool = True) -> Column:
    """Lines without leading bullets, empty ones dropped."""
    text = nfkc(text) if normalize else text
    return F.array_join(F.filter(F.transform(lines(text), strip_leading_marks), lambda x: x != ""), "\n")


def segment(note: Column, normalize: bool = True) -> Column:
    """The segments of a note: split at line ends and bullets, sanitized, without blanks and dots at either end."""
    note = nfkc(note) if normalize else note
    parts = F.transform(lines(F.replace(note, F.lit("●"), F.lit("\n"))), lambda x: F.trim(strip_leading_marks(x), F.lit(" .")))
    return F.filter(parts, lambda x: x != "")


def split_trimmed(text: Column, pattern: str) -> Column:
    """Parts between matches of a pattern, trimmed, empty ones dropped; an empty array for null."""
    by_pattern = F.transform(F.split(text, pattern), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    # the same in less time, but for blanks before a last line end of these kinds, which the pattern drops
    rare = text.contains("\x85") | text.contains("\u2028") | text.contains("\u2029")
    parts = F.when(rare, by_pattern).otherwise(F.transform(F.split(text, pattern), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r"))))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def complaint_terms(text: Column) -> Column:
    return split_trimmed(text, r"[\r\n●]+")


def comma_terms(text: Column) -> Column:
    return split_trimmed(text, ",")


def to_curie(prefix: str, identifier: Column) -> Column:
    """PREFIX:0001234 from the first run of digits; null without one or for none, null and unmatched."""
    raw = F.trim(identifier.cast("string"))
    digits = F.regexp_extract(raw, r"(\d+)", 1)
    name = "HP" if prefix.upper() in ("HP", "HPO") else prefix.upper()
    padded = F.when(F.length(digits) < 7, F.lpad(digits, 7, "0")).otherwise(digits)
    return F.when(~F.lower(raw).isin("none", "null", "unmatched") & (digits != ""), F.concat(F.lit(f"{name}:"), padded))


def clean_diagnosis(term: Column) -> Column:
    """From the first to the last ASCII letter of the first line that has one; empty otherwise."""
    return F.trim(F.coalesce(F.regexp_extract(term, "[a-zA-Z].*[a-zA-Z]|[a-zA-Z]", 0), F.lit("")))


def normalize_label(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), r"\s+", " ")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits between word borders."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z0-9]+)\b"), F.lit(1))


def stem(token: Column) -> Column:
    return F.regexp_replace(token, "(ing|ed|es|s)$", "")


def strip_dose_forms(term: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(term), DOSE_FORMS, ""))


def strip_strength(term: Column) -> Column:
    return F.trim(F.regexp_replace(term, STRENGTH, ""))


def strip_special(term: Column) -> Column:
    """Without bracketed parts and punctuation; if that leaves nothing, brackets keep their words."""
    plain = lambda c: F.regexp_replace(c, r"[^\w\s]", " ")
    bare = F.trim(F.regexp_replace(plain(F.regexp_replace(F.regexp_replace(term, r"\([^)]*\)", " "), r"\[[^\]]*\]", " ")), r"\s+", " "))
    return F.coalesce(F.when(bare != "", bare).otherwise(F.trim(plain(term))), F.lit(""))


def digest_sentence(molecule: Column, brand: Column, indication: Column) -> Column:
    """A sentence on a medicine from the parts that are there.

    A leading acronym of the indication keeps its case, otherwise its first
    letter is lowered; one closing dot is dropped before the sentence's own.
    """
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    m, b, i = clean(molecule), clean(brand), clean(indication)
    word = F.regexp_extract(i, r"^\S+", 0)
    acronym = (word == F.upper(word)) & (word != F.lower(word)) & (F.length(word) > 1)
    use = F.regexp_replace(F.when(acronym, i).otherwise(F.concat(F.lower(F.substring(i, 1, 1)), F.substring(i, 2, 1 << 30))), r"\.$", "")
    named = F.when((m != "") & (b != ""), F.concat(m, F.lit(", marketed as "), b)).when(m != "", m).when(b != "", b).otherwise("Medication")
    verb = F.when((m != "") & (b != ""), ", is used as ").when((m != "") | (b != ""), " is used as ").otherwise(" used as ")
    return F.concat(named, F.when(i != "", F.concat(verb, use)).otherwise(""), F.lit("."))


def component_tokens(brand: Column, molecule: Column, strengths: Column, mode: str) -> Column:
    """Lower-case names by which a medicine is matched: brand, molecule, or fdc_broken, its active components."""
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    none = F.array().cast("array<string>")
    one = lambda c: F.when(norm(c) != "", F.array(norm(c))).otherwise(none)
    if mode == "brand":
        return one(brand)
    if mode == "molecule":
        return one(molecule)
    if mode != "fdc_broken":
        raise ValueError(f"unknown mode: {mode}")
    listed = lambda arr: F.filter(F.transform(arr, norm), lambda x: x != "")
    keys = F.coalesce(listed(F.map_keys(strengths)), none)
    parts = listed(F.split(F.coalesce(molecule, F.lit("")), r"\+"))
    count = F.coalesce(F.size(F.map_keys(strengths)), F.lit(0))
    return (
        F.when((count > 1) & (F.size(keys) > 0), keys)
        .when(F.coalesce(molecule, F.lit("")).contains("+") & (F.size(parts) > 0), parts)
        .when((count == 1) & (F.size(keys) > 0), keys)
        .when(norm(molecule) != "", F.array(norm(molecule)))
        .otherwise(one(brand))
    )


def weighted_text_score(query: Column, fields: list[tuple[Column, float]]) -> Column:
    """Sum over fields of weight times the share of distinct query tokens that the field holds."""
    wanted = F.array_distinct(tokens(query))
    total = F.lit(0.0)
    for text, weight in fields:
        total = total + F.lit(weight) * F.size(F.array_intersect(wanted, tokens(F.coalesce(text, F.lit("")))))
    return F.when(F.size(wanted) > 0, total / F.size(wanted)).otherwise(0.0)


def base_run_id(run_id: Column) -> Column:
    """A run's identifier without the suffix of a step's file."""
    short = F.regexp_replace(run_id, r"_(?:step\d+(?:_response|_prompt)?|response|prompt|triage|clinical_summary|symptom_notes)$", "")
    return F.when(short != "", short).otherwise(run_id)


def run_id(case_no: Column, now: Column) -> Column:
    """A new identifier of a run: its case, if there is one, the second and six random letters."""
    head = F.coalesce(F.concat(F.lit("case_"), case_no.cast("string")), F.lit("run"))
    return F.concat(head, F.lit("_"), F.date_format(now, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 6))


class SegmentNote:
    """The segments of one note with their places: a table function for lateral joins, by the rules of ``segment``."""

    def eval(self, note: str):
        import regex

        if note is None:
            return
        place = 0
        for line in regex.split(r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", unicodedata.normalize("NFKC", note).replace("●", "\n")):
            bare = regex.sub(rf"^(?:[ \t\n\x0B\f\r]|(?![{KEPT_MARKS}])[\p{{S}}\p{{P}}])+", "", line)
            bare = regex.sub(r"[ \t\n\x0B\f\r]+$", "", bare).strip(" .")
            if bare:
                yield place, bare
                place += 1


def register_segments(spark: SparkSession, name: str = "segment_note") -> None:
    """Makes ``segment_note(note)`` known to a session's SQL: ``FROM notes, LATERAL segment_note(note)``."""
    spark.udtf.register(name, F.udtf(SegmentNote, returnType="pos int, segment string"))
