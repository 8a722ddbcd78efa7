"""Case numbers and the demographics of source rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def case_number(raw: Column) -> Column:
    """The digits of a case number as a number: 0 for null, null for text without a digit (the raw text stays beside it)."""
    text = F.trim(raw.cast("string"))
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.when(digits != "", digits).try_cast("long"))


def case_label(number: Column, prefix: str = "DT") -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def fractional_age(years: Column, months: Column, days: Column) -> Column:
    """Years with months and days as fractions, two decimals; what cannot be read counts as 0."""
    part = lambda c: F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(0.0))
    return F.round(part(years) + part(months) / 12 + part(days) / 365.25, 2)


def source_gender(raw: Column) -> Column:
    """f if the text starts with f, m otherwise and where it is missing."""
    return F.when(F.lower(F.trim(raw)).startswith("f"), "f").otherwise("m")


def age_group(age: Column) -> Column:
    """The reporting cohorts, which are not the similarity bands."""
    return F.when(age <= 5, "0-5").when(age <= 12, "6-12").when(age <= 21, "12-21").when(age <= 45, "22-45").when(age <= 65, "46-65").otherwise("65+")


def consultation_type(visit: Column) -> Column:
    low = F.lower(F.trim(visit))
    return F.when(low.contains("new"), "New Consultation").when(low.contains("follow"), "Follow-up").when(F.coalesce(low, F.lit("")) == "", "Unknown").otherwise(F.initcap(F.trim(visit)))


def display_gender(gender: Column) -> Column:
    text = F.trim(gender)
    return F.when(F.coalesce(gender, F.lit("")) == "", "Unknown").otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30))))


def count_bucket(count: Column) -> Column:
    return F.when(count > 5, "5+").otherwise(count.cast("string"))
