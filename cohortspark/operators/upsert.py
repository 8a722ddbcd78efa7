"""Keyed writes on immutable tables: each returns the table's next state, to be written beside the old one and swapped in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def last_per_key(rows: DataFrame, keys: list[str], ordinal: str | None = None) -> DataFrame:
    """One row a key: the last by ``ordinal``, which is dropped.

    Without an ordinal nothing says which row is newest; the choice is then the
    largest by the rows' own values, as JSON, the same in every run.
    """
    if ordinal is None:
        rows, ordinal = rows.withColumn("__ordinal", F.to_json(F.struct(*rows.columns))), "__ordinal"
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ordinal)))
    return rows.withColumn("__n", newest).where("__n = 1").drop("__n", ordinal)


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], columns: list[str] | None = None, new_id: str | None = None, insert: bool = True) -> DataFrame:
    """The table with updates set by key: given columns (all of the updates', if none) replaced, new keys inserted.

    With ``new_id``, inserted rows get a fresh identifier in that column.  With
    ``insert=False`` only rows that are there change.  Updates have one row a key.
    """
    changed = [c for c in (columns or updates.columns) if c not in keys]
    u = updates.select(*(F.col(k).alias(f"__k_{k}") for k in keys), *(F.col(c).alias(f"__u_{c}") for c in changed), F.lit(True).alias("__new"))
    t = table.withColumn("__old", F.lit(True))
    on = [t[k].eqNullSafe(u[f"__k_{k}"]) for k in keys]
    joined = t.join(u, on, "full_outer" if insert else "left")

    def value(c: str):
        if c in keys:
            return F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__k_{c}"))
        if c in changed:
            return F.when(F.col("__new"), F.col(f"__u_{c}")).otherwise(F.col(c))
        if c == new_id:
            return F.when(F.col("__old"), F.col(c)).otherwise(F.uuid())
        return F.col(c)

    return joined.select(*(value(c).alias(c) for c in table.columns))


def upsert_counts(table: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many updates match a row and how many are new."""
    found = updates.select(*keys).join(table.select(*keys).distinct().withColumn("__old", F.lit(1)), keys, "left")
    return found.agg(F.count("__old").alias("matched"), F.count_if(F.col("__old").isNull()).alias("upserted"))


def patch_column(table: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """One column replaced where the updates (key, column) have the key, a null included."""
    return upsert(table, updates.select(key, column), [key], [column], insert=False)


def upsert_medicines(table: DataFrame, updates: DataFrame) -> DataFrame:
    """Medicine master upsert by brand, molecule and dosage group; an update without a group changes every group of its brand and molecule."""
    keys = ["brand_name", "canonical_molecule", "dosage_group_id"]
    exact = upsert(table, updates.where("dosage_group_id is not null"), keys)
    loose = updates.where("dosage_group_id is null").drop("dosage_group_id")
    there = loose.join(exact.select(*keys[:2]).distinct(), keys[:2], "left_semi")
    fresh = loose.join(exact.select(*keys[:2]).distinct(), keys[:2], "left_anti").withColumn("dosage_group_id", F.lit(None).cast("string"))
    return upsert(exact, there, keys[:2], insert=False).unionByName(fresh, allowMissingColumns=True)


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has: what a unique index would refuse."""
    return table.groupBy(*keys).count().where("count > 1")


def counted_upsert(table: DataFrame, updates: DataFrame, keys: list[str], path: str, columns: list[str] | None = None) -> dict[str, int]:
    """Writes the table's next state to ``path`` and counts what the write does: upserted, matched and modified rows.

    The counts are observed in the write itself, in one pass over the joined
    rows.  A row is modified if a column that the update sets has another
    value than before, null included.  Updates have one row a key.
    """
    changed = [c for c in (columns or updates.columns) if c not in keys]
    u = updates.select(*(F.col(k).alias(f"__k_{k}") for k in keys), *(F.col(c).alias(f"__u_{c}") for c in changed), F.lit(True).alias("__new"))
    t = table.withColumn("__old", F.lit(True))
    joined = t.join(u, [t[k].eqNullSafe(u[f"__k_{k}"]) for k in keys], "full_outer")
    old, new = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    other = F.lit(False)
    for c in changed:
        other = other | ~F.col(c).eqNullSafe(F.col(f"__u_{c}"))
    watch = Observation()
    watched = joined.observe(watch, F.count_if(new & ~old).alias("upserted"), F.count_if(new & old).alias("matched"), F.count_if(new & old & other).alias("modified"))

    def value(c: str) -> Column:
        if c in keys:
            return F.when(old, F.col(c)).otherwise(F.col(f"__k_{c}"))
        return F.when(new, F.col(f"__u_{c}")).otherwise(F.col(c)) if c in changed else F.col(c)

    watched.select(*(value(c).alias(c) for c in table.columns)).write.parquet(path)
    return dict(watch.get)
