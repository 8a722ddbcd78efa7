"""Ranking of medicines by their use in similar cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import spread

BRANDS = 5


def best_evidence(pairs: DataFrame, by: list[str], weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Best ontology and best vector similarity of a case's entities, taken apart, and their weighted mean as clinical_sim.

    ``pairs`` has ``by``, lca and cos, one row a (query entity, case entity).
    """
    best = pairs.groupBy(*by).agg(F.max("lca").alias("best_lca"), F.max("cos").alias("best_cos"))
    return best.withColumn("clinical_sim", V.composite([(F.col("best_lca"), weights[0]), (F.greatest(F.col("best_cos"), F.lit(0.0)), weights[1])]))


def top_cases(scored: DataFrame, by: list[str], limit: int, min_similarity: float, age: Column | None = None, gender: Column | None = None) -> DataFrame:
    """Cases of each query entity above the cut, of a fitting age, by case score; one window serves all entities."""
    rows = scored.where(F.col("clinical_sim") >= min_similarity)
    demographic = F.lit(None).cast("double")
    if age is not None:
        rows = rows.where(V.ages_compatible(age, F.col("age")))
        demographic = V.demographic_similarity(age, F.col("age"), gender if gender is not None else F.lit(None).cast("string"), F.col("gender"))
    rows = rows.withColumn("case_score", V.case_score(F.col("clinical_sim"), demographic))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("case_score"), F.desc("clinical_sim"), "case_id"))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def molecule_usage(cases: DataFrame, medicines: DataFrame, by: list[str], num_top: int | None = None, once_per_case: bool = True) -> DataFrame:
    """Per molecule: frequency, mean and summed score, share of the top cases, first brands and whether it is a combination.

    A case counts once for a molecule, letters' case aside, under the spelling
    that comes first in it; ``once_per_case=False`` counts every mention.
    """
    used = cases.select(*by, "case_id", "case_score", "place").join(medicines, "case_id")
    if once_per_case:
        first = Window.partitionBy(*by, "case_id", F.lower("molecule")).orderBy("pos")
        used = used.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    total = cases.groupBy(*by).agg(F.count("*").alias("__cases")) if num_top is None else cases.select(*by).distinct().withColumn("__cases", F.lit(num_top))
    brands = F.slice(F.array_sort(F.collect_set(F.when(F.lower("brand") != F.lower("molecule"), F.col("brand")))), 1, BRANDS)
    rows = used.groupBy(*by, "molecule").agg(
        F.count("*").alias("frequency"),
        F.round(F.avg("case_score"), 4).alias("avg_similarity"),
        F.round(F.sum("case_score"), 4).alias("score"),
        brands.alias("brands"),
        F.max_by("is_fdc", F.struct("place", "pos")).alias("is_fdc"),
    )
    return rows.join(total, by).withColumn("percentage", F.round(F.col("frequency") / F.col("__cases") * 100, 1)).drop("__cases")


def top_molecules(usage: DataFrame, by: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("frequency"), F.desc("avg_similarity"), "molecule"))
    return usage.withColumn("rank", place).where(F.col("rank") <= k)


def rank_medicines(pairs: DataFrame, cases: DataFrame, medicines: DataFrame, by: list[str], k: int = 10, limit: int = 20, min_similarity: float = 0.5, age: Column | None = None, gender: Column | None = None) -> DataFrame:
    """Molecules for every query entity at once.

    The age predicate is applied to the cases before their similarities are
    aggregated; ``cases`` has case_id, age and gender, ``medicines`` case_id,
    pos, molecule, brand and is_fdc.  Pairs are dealt by case to many tasks, as
    a task joins, aggregates and sorts what it gets.
    """
    fitting = cases if age is None else cases.where(V.ages_compatible(age, F.col("age")))
    evidence = best_evidence(spread(pairs, "case_id").join(fitting.select("case_id"), "case_id", "left_semi"), [*by, "case_id"])
    top = top_cases(evidence.join(fitting, "case_id"), by, limit, min_similarity, age, gender)
    return top_molecules(molecule_usage(top, medicines, by), by, k)


def merged_checks(matrix: DataFrame, checks: DataFrame) -> DataFrame:
    """Matrix rows (entity, molecules) with the molecules of an answer's checks (entity, molecules) that they lack appended."""
    asked = checks.groupBy(F.lower("entity").alias("__e")).agg(F.array_distinct(F.flatten(F.collect_list("molecules"))).alias("__more"))
    joined = matrix.join(asked, F.lower("entity") == F.col("__e"), "left")
    known = F.transform("molecules", lambda x: F.lower(x))
    more = F.filter(F.coalesce("__more", F.array().cast("array<string>")), lambda x: ~F.array_contains(known, F.lower(x)))
    return joined.withColumn("molecules", F.concat("molecules", more)).drop("__e", "__more")
