"""Session defaults."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "cohortspark", **conf: str) -> SparkSession:
    """A session with the engine's defaults; pass further settings by name, dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the checkpoint folder that the cluster names; a local run without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='cohortspark-')}")


def written(rows: DataFrame) -> DataFrame:
    """``rows`` written once to the checkpoint folder, for steps that read them more than once."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


#: Rows of a written table up to which it is sent to every task.
SENT_ROWS = 20_000


def sent(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is known to be small: rows that meet it need not be shuffled by a few frequent keys."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


TASKS_A_CORE = 16


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt out by ``keys`` to many tasks, for steps that are heavy or hold much.

    Their number stays: a small file or a few small shuffled parts, packed well, would become one task of great size.
    """
    spark = rows.sparkSession
    return rows.repartition(max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
