"""Incremental ingestion: micro-batches of encounters are assembled and upserted into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import last_per_key, upsert
from ..sources.sinks import read_table, recover, swap_in


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert_buckets(spark: SparkSession, rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Upserts into a table kept as ``buckets`` folders by key; only folders whose keys are among ``rows`` are rewritten.

    Each folder is swapped on its own, so a run that is cut short leaves whole
    folders, some of the old and some of the new state; running the same rows
    again completes it.  ``read_buckets`` reads the table.
    """
    numbered = rows.withColumn("__bucket", _bucket(keys, buckets)).persist()
    try:
        touched = [r["__bucket"] for r in numbered.select("__bucket").distinct().collect()]  # at most ``buckets`` numbers
        for b in sorted(touched):
            mine = numbered.where(F.col("__bucket") == b).drop("__bucket")
            table = read_table(spark, f"{path}/part{b:05d}")
            swap_in(spark, upsert(mine.limit(0) if table is None else table, mine, keys), f"{path}/part{b:05d}")
    finally:
        numbered.unpersist()


def read_buckets(spark: SparkSession, path: str, buckets: int) -> DataFrame | None:
    """A table of ``upsert_buckets``, recovered; None if it has no folder yet."""
    found = [f"{path}/part{b:05d}" for b in range(buckets) if recover(spark, f"{path}/part{b:05d}")]
    return spark.read.parquet(*found) if found else None


def stream_upserts(source: DataFrame, path: str, keys: list[str], ordinal: str, checkpoint: str, decorate: Callable[[DataFrame], DataFrame] | None = None, once: bool = True, buckets: int = 0) -> StreamingQuery:
    """Starts a stream that keeps the newest row of each key in the table at ``path``.

    ``ordinal`` orders rows of a key within a batch.  A batch that is run again
    after a failure, at whatever step, gives the same table.  ``once`` ends when the input that is
    there has been read.  With ``buckets`` the table is kept in so many folders
    by key, and a batch rewrites only those it touches.
    """

    def apply(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = last_per_key(batch, keys, ordinal)
        rows = decorate(rows) if decorate else rows
        if buckets:
            upsert_buckets(spark, rows, path, keys, buckets)
            return
        table = read_table(spark, path)
        swap_in(spark, upsert(rows.limit(0) if table is None else table, rows, keys), path)

    writer = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def status(query: StreamingQuery) -> dict:
    """Whether the stream runs, its last progress and its error."""
    progress = query.lastProgress
    return {"running": query.isActive, "batch": progress.batchId if progress else None, "rows": progress.numInputRows if progress else 0, "error": str(query.exception()) if query.exception() else None}
