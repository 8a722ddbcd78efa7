"""Writers: appends, staged swaps, JSON lines and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _paths(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    target, staged, old = make(path), make(f"{path}.__staged"), make(f"{path}.__old")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target, staged, old


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not rename {source.toString()} to {target.toString()}")


def recover(spark: SparkSession, path: str) -> bool:
    """Brings a table back to a whole state after a swap that was cut short; tells whether there is a table.

    A missing table is replaced by the staged one if that was written in full,
    otherwise by the one that had been put aside; what is left over goes only
    when the table itself is there.
    """
    fs, target, staged, old = _paths(spark, path)
    if not fs.exists(target):
        done = spark._jvm.org.apache.hadoop.fs.Path(staged, "_SUCCESS")
        if fs.exists(staged) and fs.exists(done):
            _rename(fs, staged, target)
        elif fs.exists(old):
            _rename(fs, old, target)
    there = fs.exists(target)
    if there:
        fs.delete(old, True)
    fs.delete(staged, True)
    return there


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` after ``recover``; None if there is none."""
    return spark.read.parquet(path) if recover(spark, path) else None


def swap_in(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replaces a table by a state derived from it: staged beside it, then renamed.

    At any moment either the table or a whole copy of it is on disk, and
    ``recover``, which ``read_table`` calls, puts it back in place.
    """
    recover(spark, path)
    fs, target, staged, old = _paths(spark, path)
    df.write.parquet(staged.toString())
    if fs.exists(target):
        _rename(fs, target, old)
    _rename(fs, staged, target)
    fs.delete(old, True)


def clear(spark: SparkSession, path: str) -> int:
    """Empties a table, its columns kept; the number of rows that went."""
    table = read_table(spark, path)
    if table is None:
        return 0
    n = table.count()
    swap_in(spark, table.limit(0), path)
    return n


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def csv_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
