"""A ledger of model calls: each distinct prompt is asked once, its answer is kept, and a run that broke off goes on where it was."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# How often a call is tried again, and the first wait in seconds, which doubles.
RETRIES, WAIT = 3, 5.0
SCHEMA = "digest string, model string, prompt string, answer string, error string, tries int"


def call_digest(prompts: DataFrame, model: str) -> DataFrame:
    """(digest, prompt): distinct prompts that are not null, under the digest of model and prompt."""
    return prompts.select("prompt").where("prompt is not null").distinct().select(F.sha2(F.concat(F.lit(f"{model}\n"), "prompt"), 256).alias("digest"), "prompt")


def _calling(ask: Callable[[str], str], model: str, retries: int, wait: float, sleep: Callable[[float], None]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def one(prompt: str) -> tuple[str | None, str | None, int]:
        error = None
        for attempt in range(retries + 1):
            if attempt:
                sleep(wait * 2 ** (attempt - 1))
            try:
                return ask(prompt), None, attempt + 1
            except Exception as e:  # any failure of a service is tried again, and told in the ledger at last
                error = f"{type(e).__name__}: {e}"
        return None, error, retries + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = batch.column("prompt").to_pylist()
            answers = [one(p) for p in prompts]
            kind = pa.schema([("digest", pa.string()), ("model", pa.string()), ("prompt", pa.string()), ("answer", pa.string()), ("error", pa.string()), ("tries", pa.int32())])
            columns = [batch.column("digest"), [model] * len(prompts), prompts, *(list(x) for x in zip(*answers, strict=True))] if prompts else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, kind, strict=True)], schema=kind)

    return run


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: a row for each answer; calls that failed in the end have an error in their last row and no answer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(SCHEMA).parquet(f"{path}/*") if there else spark.createDataFrame([], SCHEMA)


def settled(spark: SparkSession, path: str) -> DataFrame:
    """One row for each digest: its answer if it has one, else the error of a failed call."""
    best = F.max_by(F.struct("model", "prompt", "answer", "error", "tries"), F.struct(F.col("answer").isNotNull(), F.coalesce("answer", "error")))
    return entries(spark, path).groupBy("digest").agg(best.alias("e")).select("digest", "e.*")


def answered(prompts: DataFrame, path: str, ask: Callable[[str], str], model: str, chunks: int = 16, retries: int = RETRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``prompts`` with answer, error and tries of each from the ledger at ``path``, after asking what it does not have yet.

    Distinct prompts are asked, those with a kept answer never again; calls
    that failed are asked again by the next run.  Work is cut into ``chunks``
    by digest, each committed as a folder of its own: a run that is broken off
    loses one chunk's calls at most, and a task that is run again before its
    chunk is committed writes that chunk's answers once.  Null prompts are not
    asked.  Two runs at one time may ask a prompt twice; one answer is used.
    """
    spark = prompts.sparkSession
    ensure_checkpoint_dir(spark)
    have = entries(spark, path).where("answer is not null").select("digest").distinct()
    missing = call_digest(prompts, model).join(have, "digest", "left_anti").withColumn("chunk", F.pmod(F.xxhash64("digest"), F.lit(chunks)).cast("int")).checkpoint()
    for chunk in sorted(r.chunk for r in missing.select("chunk").distinct().collect()):  # at most ``chunks``
        part = missing.where(F.col("chunk") == chunk).select("digest", "prompt")
        part.mapInArrow(_calling(ask, model, retries, wait, sleep), SCHEMA).write.parquet(f"{path}/{chunk:04d}-{uuid.uuid4().hex[:12]}")
    kept = settled(spark, path).select("digest", "answer", "error", "tries")
    named = prompts.withColumn("__digest", F.sha2(F.concat(F.lit(f"{model}\n"), "prompt"), 256))
    clear = [c for c in ("answer", "error", "tries") if c in prompts.columns]
    return named.drop(*clear).join(kept, F.col("__digest") == F.col("digest"), "left").drop("__digest", "digest")
