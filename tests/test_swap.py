"""A swap that is cut short at any step leaves a whole table."""

import os
import shutil

import pytest

from cohortspark.sources import sinks
from cohortspark.streaming import ingest

SCHEMA = "k long, name string, n long"


def table(spark, path):
    return sorted((r.k, r.name) for r in sinks.read_table(spark, path).collect())


def test_a_table_put_aside_comes_back(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.swap_in(spark, spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA), path)
    os.rename(path, path + ".__old")  # stopped between the renames, nothing staged in full
    os.makedirs(path + ".__staged")
    assert table(spark, path) == [(1, "a"), (2, "b")] and not os.path.exists(path + ".__old")


def test_a_staged_table_is_taken_up(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.swap_in(spark, spark.createDataFrame([(1, "a", 1)], SCHEMA), path)
    spark.createDataFrame([(1, "a", 1), (3, "c", 1)], SCHEMA).write.parquet(path + ".__staged")
    os.rename(path, path + ".__old")  # stopped before the second rename
    assert table(spark, path) == [(1, "a"), (3, "c")]
    assert not os.path.exists(path + ".__old") and not os.path.exists(path + ".__staged")


def test_a_staged_table_beside_the_table_is_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.swap_in(spark, spark.createDataFrame([(1, "a", 1)], SCHEMA), path)
    spark.createDataFrame([(9, "z", 1)], SCHEMA).write.parquet(path + ".__staged")
    assert table(spark, path) == [(1, "a")] and not os.path.exists(path + ".__staged")
    assert sinks.read_table(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("buckets", [0, 4])
@pytest.mark.parametrize("step", [0, 1, 2])
def test_a_stream_survives_a_crash_between_the_steps(spark, tmp_path, monkeypatch, step, buckets):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "table", "ck"))
    write = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda: ingest.stream_upserts(spark.readStream.schema(SCHEMA).parquet(source), target, ["k"], "n", checkpoint, buckets=buckets)
    write([(k, "old", 1) for k in range(6)])
    run().awaitTermination()
    write([(1, "new", 2), (7, "new", 2)])
    real, calls = sinks._rename, []

    def failing(fs, a, b):
        calls.append(1)
        if len(calls) == step:
            raise OSError("stopped here")
        real(fs, a, b)
        if step == 0 and len(calls) == 1:
            raise OSError("stopped after the first")

    monkeypatch.setattr(sinks, "_rename", failing)
    with pytest.raises(Exception, match="stopped"):
        run().awaitTermination()
    monkeypatch.setattr(sinks, "_rename", real)
    run().awaitTermination()
    rows = ingest.read_buckets(spark, target, buckets) if buckets else sinks.read_table(spark, target)
    assert sorted((r.k, r.name) for r in rows.collect()) == [(0, "old"), (1, "new"), (2, "old"), (3, "old"), (4, "old"), (5, "old"), (7, "new")]


def test_clear(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.clear(spark, path) == 0
    sinks.swap_in(spark, spark.range(5), path)
    assert sinks.clear(spark, path) == 5 and spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["id"]
    shutil.rmtree(path)
