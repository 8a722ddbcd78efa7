"""Readers of the engine's inputs: relational tables, JSON arrays and ontology files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEDICINE_SCHEMA = T.StructType(
    [
        T.StructField("brand_name", T.StringType()),
        T.StructField("canonical_molecule", T.StringType()),
        T.StructField("is_fdc", T.BooleanType()),
        T.StructField("constituent_strengths_mg", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("modal_strength_mg", T.DoubleType()),
        T.StructField("release_form", T.StringType()),
        T.StructField("dosage_tier", T.StringType()),
        T.StructField("dosage_group_id", T.StringType()),
        T.StructField("clinical_dosing_indication", T.StringType()),
    ]
)

#: Column names of the source tables, whose spelling varies, and ours.
SOURCE_COLUMNS = {
    "case No": "case_no", "Case No": "case_no", "CaseNo": "case_no", "Gender": "gender", "Age Day": "age_day", "Age Month": "age_month", "Age Year": "age_year", "Visit Date": "visit_date_raw",
    "Chief Complaints": "chief_complaints", "Diagnosis Name": "diagnosis", "Visit Reason": "visit_reason", "Medicine Name": "medicine", "Investigation Name": "investigation",
}


def jdbc_table(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, fetch_size: int = 10_000, **options: str) -> DataFrame:
    """A table over JDBC, read in parallel ranges of a numeric column (name, lower, upper, parts) where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch_size), **options)
    if partition:
        column, lower, upper, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return reader.load()


def normalized(df: DataFrame) -> DataFrame:
    """A source table under our column names, with the visit date parsed beside its text."""
    from ..functions.dates import clinical_date

    out = df.withColumnsRenamed({k: v for k, v in SOURCE_COLUMNS.items() if k in df.columns})
    return out.withColumn("visit_date", clinical_date(F.col("visit_date_raw"))) if "visit_date_raw" in out.columns else out


def first_rows(df: DataFrame, order: str, limit: int) -> DataFrame:
    return df.orderBy(order).limit(limit)


def json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """The objects of files that hold one JSON array each.

    ``strict`` fails on malformed input and on a file that holds anything but
    an array; otherwise what does not fit gives no row, and a path without
    files an empty table, if ``schema`` is given.
    """
    try:
        heads = spark.read.text(path, wholetext=True).select(F.ltrim(F.regexp_replace("value", r"^[\s\ufeff]+", "")).startswith("[").alias("ok"))
    except AnalysisException as error:
        if strict or schema is None or "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    whole = heads.agg(F.coalesce(F.every("ok"), F.lit(True))).first()[0]
    if not whole and strict:
        raise ValueError(f"{path}: expected a JSON array")
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    rows = (reader.schema(schema) if schema else reader).json(path)
    return rows if whole else rows.limit(0)


def medicine_master(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return json_array(spark, path, MEDICINE_SCHEMA, strict)


#: A result record's request and expected medicines.
CASE_SCHEMA = T.StructType(
    [
        T.StructField(
            "req",
            T.StructType(
                [
                    T.StructField(
                        "case",
                        T.StructType(
                            [
                                T.StructField("caseNo", T.LongType()),
                                T.StructField("caseDate", T.StringType()),
                                T.StructField("visitType", T.StringType()),
                                T.StructField("patientInfo", T.StructType([T.StructField("age", T.DoubleType()), T.StructField("gender", T.StringType())])),
                                T.StructField("symptoms", T.ArrayType(T.StringType())),
                                T.StructField("diagnosis", T.ArrayType(T.StringType())),
                            ]
                        ),
                    )
                ]
            ),
        ),
        T.StructField("expectedMeds", T.ArrayType(MEDICINE_SCHEMA)),
    ]
)


def batch_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a batch file: a JSON array of request and expected medicines, flattened, numbered by their place."""
    rows = json_array(spark, path, CASE_SCHEMA)
    case = F.col("req.case")
    age, gender = case["patientInfo"]["age"], case["patientInfo"]["gender"]
    return rows.select(case["caseNo"].alias("case_no"), case["caseDate"].alias("case_date"), case["visitType"].alias("visit_type"), age.alias("age"), gender.alias("gender"), case["symptoms"].alias("symptoms"), case["diagnosis"].alias("diagnoses"), F.col("expectedMeds").alias("expected"))


def result_path(spark: SparkSession, given: str | None, folders: list[str], pattern: str = "prescribe_pipeline_*.json") -> str:
    """The result file to read: the one given, as it is or in one of the folders, or else the newest of a pattern there."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = make(path)
        return p.getFileSystem(conf).exists(p)

    if given:
        for path in [given, *(f"{folder}/{given}" for folder in folders)]:
            if there(path):
                return path
        raise FileNotFoundError(given)
    for folder in folders:
        p = make(f"{folder}/{pattern}")
        if p.getFileSystem(conf).globStatus(p):
            return newest_file(spark, f"{folder}/{pattern}")
    raise FileNotFoundError(pattern)


def ping(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(store, ok, detail): whether each store answers a read of one row."""
    rows = []
    for name, path in sorted(paths.items()):
        try:
            spark.read.parquet(path).limit(1).count()
            rows.append((name, True, None))
        except Exception as error:  # the report says what went wrong
            rows.append((name, False, str(error).splitlines()[0]))
    return spark.createDataFrame(rows, "store string, ok boolean, detail string")


def newest_file(spark: SparkSession, pattern: str) -> str | None:
    """The path of the newest file that matches a glob, by modification time, in any store."""
    found = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    row = found.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1).collect()
    return row[0]["path"] if row else None


def ontology_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(stanza): the [Term] blocks of an ontology file; blocks are cut at empty lines by the reader, so large files split."""
    return spark.read.text(path, lineSep="\n\n").where(F.trim("value").startswith("[Term]")).select(F.col("value").alias("stanza"))


def ontology_terms(stanzas: DataFrame, prefix: str) -> DataFrame:
    """Terms of a prefix: id, label, synonyms, definition, alt_ids, parents and is_obsolete."""
    one = lambda key: F.regexp_extract("stanza", rf"(?m)^{key}:\s*(.*?)\s*$", 1)
    every = lambda pattern: F.regexp_extract_all("stanza", F.lit(rf"(?m)^{pattern}"), F.lit(1))
    rows = stanzas.select(
        one("id").alias("id"),
        one("name").alias("label"),
        every(r'synonym:\s*"((?:[^"\\]|\\.)*)"').alias("synonyms"),
        F.regexp_extract("stanza", r'(?m)^def:\s*"((?:[^"\\]|\\.)*)"', 1).alias("definition"),
        every(r"alt_id:\s*(\S+)").alias("alt_ids"),
        every(r"is_a:\s*([^\s!]+)").alias("parents"),
        F.col("stanza").rlike(r"(?m)^is_obsolete:\s*true").alias("is_obsolete"),
    )
    return rows.where(F.col("id").startswith(f"{prefix}:"))


def cases_view(raw: DataFrame) -> DataFrame:
    """Case documents of any of their shapes under one: symptoms, diagnosis, medications, age, gender, visit_date and visit_reason.

    Of the spellings a field has had, the first that is there and not null is taken.
    """

    def first(*names: str):
        there = [F.col(n) for n in names if _has(raw.schema, n)]
        return F.coalesce(*there) if there else F.lit(None)

    empty = F.array()
    return raw.select(
        *(c for c in ("_id", "caseNo") if c in raw.columns),
        F.coalesce(first("chiefComplaints", "symptoms"), empty).alias("symptoms") if _has(raw.schema, "chiefComplaints") or _has(raw.schema, "symptoms") else empty.alias("symptoms"),
        first("diagnosis").alias("diagnosis"),
        first("medications", "medication").alias("medications"),
        first("patientInfo.age", "age", "patient.age.year", "patient.age").cast("double").alias("age"),
        first("patientInfo.gender", "gender", "patient.gender").cast("string").alias("gender"),
        first("visitDate", "caseDate", "date").cast("string").alias("visit_date_raw"),
        first("visitReason").cast("string").alias("visit_reason"),
    )


def _has(schema: T.StructType, path: str) -> bool:
    head, _, rest = path.partition(".")
    if head not in schema.fieldNames():
        return False
    kind = schema[head].dataType
    return (isinstance(kind, T.StructType) and _has(kind, rest)) if rest else not isinstance(kind, T.StructType)
