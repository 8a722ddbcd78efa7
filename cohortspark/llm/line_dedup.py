"""Lines that repeat across documents, dropped from all but one of them, in DataFrame functions only.

Texts are exploded into lines.  A line's key, its normalised text, is hashed
to 128 bits; distinct documents are counted per hash, and lines whose key
stands in enough documents are dropped outside the smallest doc_id that holds
it.  What is dropped comes back to a document as the positions of its lines,
by which the text is put together again; texts themselves are shuffled once.

Hashes that a large share of all lines have, at most HOT_KEYS by that rule,
meet their lines by broadcast; all others by a shuffle in which no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

MIN_POINTS, MIN_DOCUMENTS = 10, 2
HOT_KEYS = 50_000
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY, ROW = ["__h1", "__h2"], ["__id", "__digest"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def hashed_lines(documents: DataFrame, min_points: int = MIN_POINTS, text: str = "text") -> DataFrame:
    """(__id, __digest, pos, __h1, __h2): a row for each line whose key has ``min_points`` code points."""
    keys = F.transform(lines(F.col(text)), line_key)
    hashes = F.transform(keys, lambda k: F.when(F.length(k) >= min_points, F.struct(F.xxhash64(k).alias(KEY[0]), F.xxhash64(F.lit(1), k).alias(KEY[1]))))
    rows = documents.select(F.col("doc_id").alias(ROW[0]), _digest(text).alias(ROW[1]), F.posexplode(hashes).alias("pos", "h"))
    return rows.where("h is not null").select(*ROW, "pos", "h.*")


def _digest(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def repeated_lines(hashed: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(__h1, __h2, keeper, n_documents, n_rows) of hashes found in ``min_documents`` distinct documents; rows without an id count as one document."""
    counted = hashed.groupBy(*KEY).agg(
        F.count_distinct(ROW[0]).alias("__n"), F.max(F.col(ROW[0]).isNull().cast("int")).alias("__without"), F.min(ROW[0]).alias("keeper"), F.count(F.lit(1)).alias("n_rows")
    )
    return counted.withColumn("n_documents", F.col("__n") + F.col("__without")).where(F.col("n_documents") >= min_documents).select(*KEY, "keeper", "n_documents", "n_rows")


def deduplicated_lines(documents: DataFrame, min_points: int = MIN_POINTS, min_documents: int = MIN_DOCUMENTS, text: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, n_lines, n_dropped and kept, the text of the lines that stay.

    Texts are cut at \\n; null and empty texts are one empty line.  Keys of at
    least ``min_points`` code points in at least ``min_documents`` (two or
    more) documents lose their lines everywhere but in the smallest doc_id
    that holds them, where all of them stay.  Rows of one doc_id are one
    document, each with its own text; rows that repeat are treated alike.
    Rows without a doc_id are one document together, which keeps nothing that
    another one holds.  Other columns are not read; an empty table gives no rows.
    """
    if min_documents < 2:
        raise ValueError("min_documents is two or more")
    scratch = Scratch(documents.sparkSession, "line_dedup")
    hashed = scratch.save(hashed_lines(documents, min_points, text))
    repeated = scratch.save(repeated_lines(hashed, min_documents))
    often = F.col("n_rows") > F.lit(hashed.count() // HOT_KEYS)
    frequent, others = F.broadcast(repeated.where(often).drop("n_rows")), repeated.where(~often).drop("n_rows")
    met = hashed.join(frequent, KEY).unionByName(hashed.join(frequent.select(*KEY), KEY, "left_anti").join(others, KEY))
    gone = met.where(~F.col(ROW[0]).eqNullSafe(F.col("keeper"))).groupBy(*ROW).agg(F.collect_set("pos").alias("__gone"))
    gone = scratch.save(gone)
    scratch.keep_only(gone)
    docs = documents.select("doc_id", F.col(text).cast("string").alias("__text"), _digest(text).alias("__own"))
    same = F.col("doc_id").eqNullSafe(F.col(ROW[0])) & (F.col("__own") == F.col(ROW[1]))
    joined = docs.join(gone, same, "left")
    # bound once for each row: a lambda's variable is not computed again inside it
    parts = F.array(F.struct(lines(F.col("__text")).alias("l"), F.col("__gone").alias("g")))
    rest = F.transform(parts, lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["l"]) - 1), s["g"]), lambda i: s["l"][i]), "\n"))[0]
    whole = F.coalesce("__text", F.lit(""))
    return joined.select(
        "doc_id",
        F.size(lines(F.col("__text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__gone").isNull(), whole).otherwise(rest).alias("kept"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(t) AS line, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), j AS (SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
