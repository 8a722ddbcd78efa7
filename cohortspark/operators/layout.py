"""Tables laid out by key: bucketed and sorted in the catalog, so that joins and sums by that key need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store_by_key(rows: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """``rows`` as the catalog table ``name``, in ``buckets`` by a hash of ``keys`` and sorted by them, one file a bucket.

    With ``path`` the files lie there instead of in the warehouse.  A key of
    very many rows makes one large file: lay out by it and more columns then.
    """
    writer = rows.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return rows.sparkSession.table(name)


def joined_by_key(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The join of two tables of one layout, as a merge of their buckets."""
    return left.hint("merge").join(right.hint("merge"), keys, how)


def upserted_by_key(table: str, updates: DataFrame, keys: list[str], name: str, buckets: int, path: str | None = None) -> DataFrame:
    """The next state of a laid-out table as the table ``name`` of the same layout; only the updates are exchanged.

    Updates have one row a key and the table's columns.
    """
    old = updates.sparkSession.table(table)
    fresh = updates.select(*keys, *(F.col(c).alias(f"__u_{c}") for c in old.columns if c not in keys), F.lit(True).alias("__new")).repartition(buckets, *keys)
    joined = joined_by_key(old, fresh, keys, "full_outer")
    rows = joined.select(*(F.col(c) if c in keys else F.when(F.col("__new"), F.col(f"__u_{c}")).otherwise(F.col(c)).alias(c) for c in old.columns))
    writer = rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return updates.sparkSession.table(name)
