"""Assembly of encounter records from source tables, and lookups of past and newest encounters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def ordered_text(df: DataFrame, keys: list[str], value: str, name: str, separator: str = ", ") -> DataFrame:
    """One text a key with the values in ascending order; nulls are left out."""
    return df.groupBy(*keys).agg(F.expr(f"listagg({value}, '{separator}') within group (order by {value})").alias(name))


def assemble(visits: DataFrame, patients: DataFrame, complaints: DataFrame, diagnoses: DataFrame, prescriptions: DataFrame, investigations: DataFrame | None = None, text_order: bool = False) -> DataFrame:
    """One row a visit with patient, complaints and the visit's aggregated diagnoses, medicines and investigations.

    Keys are case_no and visit_date.  Patients and complaints are not reduced,
    so repeated ones fan out.  ``is_latest`` marks the newest visit of a case;
    visit_date orders as a date, or as text with ``text_order``.
    """
    key = ["case_no", "visit_date"]
    out = visits.join(patients, "case_no", "left").join(complaints, key, "left")
    out = out.join(ordered_text(diagnoses, key, "diagnosis", "diagnosis_names"), key, "left").join(ordered_text(prescriptions, key, "medicine", "medicine_names"), key, "left")
    if investigations is not None:
        out = out.join(ordered_text(investigations, key, "investigation", "investigation_names"), key, "left")
    order = F.col("visit_date").cast("string") if text_order else F.col("visit_date")
    ties = [F.col("visit_id").desc()] if "visit_id" in visits.columns else []
    newest = F.row_number().over(Window.partitionBy("case_no").orderBy(order.desc(), *ties))
    return out.withColumn("is_latest", newest == 1)


def newest_matching(encounters: DataFrame, terms: list[str], column: str, exclude_case: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """The newest encounter of each case whose ``column`` holds one of ``terms``, whatever the case of letters."""
    low = F.lower(F.col(column))
    hit = F.lit(False)
    for term in terms:
        hit = hit | low.contains(term.lower())
    rows = encounters.where(hit)
    if exclude_case is not None:
        rows = rows.where(F.col("case_no") != exclude_case)
    rank = F.row_number().over(Window.partitionBy("case_no").orderBy(*(order or [F.col("visit_date").desc()])))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def patient_history(visits: DataFrame, patients: DataFrame, complaints: DataFrame, diagnoses: DataFrame, prescriptions: DataFrame, case_no: int | None, before: Column | None = None) -> DataFrame:
    """One case's visits with patient, complaints, diagnoses and medicines, oldest first; those on or after ``before`` are out.

    A visit without a readable date stays, first in order.  The case number
    reaches every source before it is joined.  Without a case there are no rows.
    """
    one = lambda df: df.where(F.lit(False) if case_no is None else F.col("case_no") == case_no)
    key = ["case_no", "visit_date"]
    out = one(visits).join(one(patients), "case_no", "left").join(one(complaints), key, "left")
    out = out.join(ordered_text(one(diagnoses), key, "diagnosis", "diagnosis_names"), key, "left").join(ordered_text(one(prescriptions), key, "medicine", "medicine_names"), key, "left")
    out = out if before is None else out.where(F.coalesce(F.col("visit_date") < before, F.lit(True)))
    ties = ["visit_id"] if "visit_id" in visits.columns else []
    return out.orderBy("visit_date", *ties)


def first_case(cases: DataFrame, case_no: int, date: Column | None = None) -> DataFrame:
    """The first row of a case, or of a case and date: a point lookup."""
    rows = cases.where(F.col("case_no") == case_no)
    rows = rows if date is None else rows.where(F.col("visit_date") == date)
    return rows.limit(1)


def past_visits(encounters: DataFrame, case_no: int, before: Column | None = None) -> DataFrame:
    """A case's encounters strictly before a date (now, if there is none), oldest first; unreadable dates are out."""
    return encounters.where((F.col("case_no") == case_no) & (F.col("visit_date") < F.coalesce(before if before is not None else F.lit(None), F.current_date()))).orderBy("visit_date")


def first_mentions(rows: DataFrame, ident: str, case: str, columns: list[str], order: list[str]) -> DataFrame:
    """``rows`` with each array column cut to the values that the case's earlier rows, in ``order``, do not have.

    Their sizes add up to a case's distinct values, however many rows it has.
    """
    out = rows
    for column in columns:
        long = rows.select(ident, case, *[c for c in order if c not in (ident, case)], F.posexplode(column).alias("__pos", "__v"))
        first = F.row_number().over(Window.partitionBy(case, "__v").orderBy(*order, "__pos"))
        new = long.withColumn("__n", first).where("__n = 1").groupBy(ident).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__v"))), lambda x: x["__v"]).alias("__new"))
        out = out.join(new, ident, "left").withColumn(column, F.coalesce("__new", F.array().cast(rows.schema[column].dataType))).drop("__new")
    return out


def with_history(encounters: DataFrame, value: str, name: str, order: list[str]) -> DataFrame:
    """Each encounter with the values of its case's earlier encounters, oldest first, repeated values once."""
    empty = F.array().cast(f"array<{encounters.schema[value].dataType.simpleString()}>")
    listed = encounters.withColumn("__list", F.when(F.col(value).isNotNull(), F.array(value)).otherwise(empty))
    return histories(listed, {name: "__list"}, order).drop("__list")


def histories(encounters: DataFrame, columns: dict[str, str], order: list[str], case: str = "case_no") -> DataFrame:
    """``encounters`` with a column for each of ``columns`` (new name: array column): the values of the case's earlier encounters.

    Values come in order of first mention, each once.  Only first mentions are
    gathered, so a row holds no more than its case's distinct values.
    """
    ensure_checkpoint_dir(encounters.sparkSession)
    numbered = encounters.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    parts = numbered.select("__row", case, *[c for c in order if c != case], *(F.coalesce(c, F.array().cast(numbered.schema[c].dataType)).alias(f"__h_{i}") for i, c in enumerate(columns.values())))
    new = first_mentions(parts, "__row", case, [f"__h_{i}" for i in range(len(columns))], [*order, "__row"])
    earlier = Window.partitionBy(case).orderBy(*order, "__row").rowsBetween(Window.unboundedPreceding, -1)
    past = new.select("__row", *(F.flatten(F.collect_list(F.when(F.size(f"__h_{i}") > 0, F.col(f"__h_{i}"))).over(earlier)).alias(name) for i, name in enumerate(columns)))
    return numbered.join(past, "__row").drop("__row")


def latest_value(encounters: DataFrame, value: str, order: list[str]) -> DataFrame:
    return encounters.groupBy("case_no").agg(F.max_by(value, F.struct(*order)).alias(value))


def distinct_in_order(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The values of a key in order of their first appearance, as an array."""
    first = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("__first"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", value))), lambda x: x[value]).alias(value))


def candidates(cases: DataFrame, exclude_case: int | None = None, visit_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Cases with medicines and diagnoses, other than one case, of a visit type; cut only where ``limit`` is given, newest first."""
    rows = cases.where((F.size("medications") > 0) & (F.size("diagnosis") > 0))
    if exclude_case is not None:
        rows = rows.where(~F.col("case_no").eqNullSafe(F.lit(exclude_case)))
    if visit_type:
        rows = rows.where(F.lower(F.col("visit_reason")).contains(visit_type.lower()))
    return rows if limit is None else rows.orderBy(F.desc("visit_date"), "case_no").limit(limit)


def before_encounter(cases: DataFrame, date: Column) -> DataFrame:
    """Cases of an earlier date; those without a readable date stay."""
    return cases.where(F.coalesce(F.col("visit_date") < date, F.lit(True)))


def lookup(cases: DataFrame, keys: DataFrame, on: list[str], small: bool = False) -> DataFrame:
    """Rows whose key is among ``keys``; pass ``small`` where their number has been checked."""
    wanted = keys.dropna(subset=on).select(*on).distinct()
    return cases.join(F.broadcast(wanted) if small else wanted, on, "left_semi")


def grouped_lookup(cases: DataFrame, case_nos: list[int]) -> DataFrame:
    """The rows of the given cases as one array a case."""
    rest = [c for c in cases.columns if c != "case_no"]
    return cases.where(F.col("case_no").isin(case_nos)).groupBy("case_no").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("cases"))
