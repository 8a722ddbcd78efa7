"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared scratch folder and reads it again as the next
stage's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import sentencepieces
from cohortspark.llm.common import Scratch, table
from cohortspark.llm.decontamination import judged
from cohortspark.llm.near_duplicates import near_duplicates
from cohortspark.llm.quality import THRESHOLD, fold_model, score_quality
from cohortspark.llm.secrets import labelled_findings, scan, train_forest


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are not among ``gone`` (doc_id, digest): a row goes by its own text, not by its id alone."""
    named = gone.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__digest"))
    return docs.join(named, same, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, all columns as they were.

    Learns from ``labels``; without any label all scores are 0.5, below the
    threshold, so nothing would be left: then every document stays.  Null and
    empty texts are scored as the empty text; rows that repeat are judged each,
    alike; an empty table gives no rows.
    """
    labels = table(spark, sf_dir, "labels")
    model = fold_model(docs, labels)
    if not model.learnt:
        return docs
    return score_quality(docs, model, "__quality").where(F.col("__quality") >= THRESHOLD).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id.

    Rows without an id, and texts without words, stay.  A row goes by its own
    text: rows of one id with other texts are other documents, rows that repeat
    id and text stay or go together.  An empty table gives no rows.
    """
    return _without(docs, near_duplicates(docs).where(~F.col("chosen")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    A row goes by its own text, whatever its id, null or shared.  Null and
    empty texts stay; an empty benchmark, or items without words, leave all.
    """
    return _without(docs, judged(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked, n_chars brought up to date where one was.

    Null and empty texts stay as they are; rows that repeat are masked each,
    alike; an empty table gives no rows.
    """
    scanned = scan(docs, train_forest(spark, labelled_findings()), names=("__findings", "__redacted"))
    size = F.when(F.exists("__findings", lambda f: f["secret"]), F.length("__redacted")).otherwise(F.col("n_chars"))
    return scanned.withColumns({"text": F.col("__redacted"), "n_chars": size.cast(docs.schema["n_chars"].dataType)}).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, ids and n_tokens of each document; a null or empty text has no ids, a null doc_id stays, an empty table gives no rows."""
    import public_tokenizers

    return sentencepieces.encoded(docs, public_tokenizers.path(sentencepieces.MODEL))


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("decontamination", decontamination), ("secrets", secrets), ("sentencepieces", pieces)]

#: Compression, signatures and piece ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
