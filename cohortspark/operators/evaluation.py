"""Evaluation of predicted against expected treatments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COHORTS = ("age_group", "gender", "consultation_type", "count_bucket")


def case_evaluation(expected: Column, predicted: Column) -> dict[str, Column]:
    """Counts and accuracy of a case from two token arrays; expected tokens that repeat count each time."""
    hits = F.filter(expected, lambda x: F.array_contains(predicted, x))
    n = F.size(expected)
    accuracy = F.when(n > 0, F.size(hits) / n * 100.0).otherwise(F.when(F.size(predicted) == 0, 100.0).otherwise(0.0))
    return {
        "expected_count": n,
        "prescribed_count": F.size(predicted),
        "matched_count": F.size(hits),
        "unmatched_expected": F.filter(expected, lambda x: ~F.array_contains(predicted, x)),
        "extra_prescribed": F.filter(predicted, lambda x: ~F.array_contains(expected, x)),
        "accuracy": accuracy,
    }


def _ratio(a: Column, b: Column, scale: float = 100.0) -> Column:
    return F.when(b > 0, a / b * scale).otherwise(0.0)


def cohort_summary(evaluated: DataFrame, cohorts: tuple[str, ...] = COHORTS) -> DataFrame:
    """Accuracy by every cohort column and overall, in one pass of grouping sets: (dimension, cohort, measures)."""
    names = {c: F.lit(c) for c in cohorts}
    sets = [[F.col(c)] for c in cohorts] + [[]]
    measures = [F.count("*").alias("cases"), F.sum("expected_count").alias("expected"), F.sum("prescribed_count").alias("prescribed"), F.sum("matched_count").alias("matched"), F.avg("accuracy").alias("mean_case_accuracy")]
    flags = [F.grouping(c).alias(f"__{c}") for c in cohorts]
    rows = evaluated.groupingSets(sets, *map(F.col, cohorts)).agg(*measures, *flags)
    dimension, cohort = F.lit("overall"), F.lit("all")
    for c in cohorts:
        dimension, cohort = F.when(F.col(f"__{c}") == 0, names[c]).otherwise(dimension), F.when(F.col(f"__{c}") == 0, F.col(c).cast("string")).otherwise(cohort)
    e, p, m = F.col("expected"), F.col("prescribed"), F.col("matched")
    return rows.select(dimension.alias("dimension"), cohort.alias("cohort"), "cases", "expected", "prescribed", "matched", F.round(_ratio(m, e), 4).alias("accuracy"), F.round("mean_case_accuracy", 4).alias("mean_case_accuracy"), F.round(_ratio(m, p), 4).alias("precision"))


def filled_cohorts(summary: DataFrame, expected: DataFrame) -> DataFrame:
    """The summary with a row of zeros for each (dimension, cohort) of ``expected`` that had no case."""
    numbers = [c for c in summary.columns if c not in ("dimension", "cohort")]
    return expected.join(summary, ["dimension", "cohort"], "left").fillna(0, numbers)


def confusion(evaluated: DataFrame) -> DataFrame:
    """TP, FP, FN and TN over sets of tokens (columns expected and predicted), TN against the catalogue of all tokens, with rates in percent.

    A case's true negatives are the catalogue less the tokens it has, so their
    sum needs only the sum of those sizes and the evaluated rows are read once.
    """
    sets = evaluated.select(F.array_distinct("expected").alias("e"), F.array_distinct("predicted").alias("p"))
    long = sets.select("e", "p", F.posexplode_outer(F.array_union("e", "p")).alias("pos", "t"))
    first, in_e, in_p = F.coalesce(F.col("pos") == 0, F.lit(True)), F.array_contains("e", F.col("t")), F.array_contains("p", F.col("t"))
    per = long.groupBy("t").agg(F.count_if(in_e & in_p).alias("tp"), F.count_if(~in_e).alias("fp"), F.count_if(~in_p).alias("fn"), F.count("t").alias("n"), F.count_if(first).alias("cases"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return with_rates(per.agg(total("tp").alias("tp"), total("fp").alias("fp"), total("fn").alias("fn"), (F.count("t") * total("cases") - total("n")).alias("tn")))


def with_rates(counted: DataFrame) -> DataFrame:
    """Precision, recall, specificity and F1 in percent from tp, fp, fn, tn; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.withColumns({"precision": F.round(_ratio(tp, tp + fp), 2), "recall": F.round(_ratio(tp, tp + fn), 2), "specificity": F.round(_ratio(tn, tn + fp), 2), "f1": F.round(_ratio(2 * tp, 2 * tp + fp + fn), 2)})


def one_vs_rest(evaluated: DataFrame, key: str = "case_id") -> DataFrame:
    """Per token: tp, fp, fn, tn, support and rates, over the sets of each case."""
    cases = evaluated.agg(F.count("*").alias("n"))
    e = evaluated.select(key, F.explode(F.array_distinct("expected")).alias("item"), F.lit(1).alias("e"), F.lit(0).alias("p"))
    p = evaluated.select(key, F.explode(F.array_distinct("predicted")).alias("item"), F.lit(0).alias("e"), F.lit(1).alias("p"))
    pairs = e.unionByName(p).groupBy(key, "item").agg(F.max("e").alias("e"), F.max("p").alias("p"))
    rows = pairs.groupBy("item").agg(F.sum(F.col("e") * F.col("p")).alias("tp"), F.sum((1 - F.col("e")) * F.col("p")).alias("fp"), F.sum(F.col("e") * (1 - F.col("p"))).alias("fn"))
    rows = rows.crossJoin(F.broadcast(cases)).withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).drop("n")  # one row
    return with_rates(rows.withColumn("support", F.col("tp") + F.col("fn")))


def macro_average(items: DataFrame) -> DataFrame:
    return items.where("support > 0").agg(*(F.round(F.avg(c), 2).alias(c) for c in ("precision", "recall", "f1")), F.count("*").alias("items"))


def count_agreement(evaluated: DataFrame, buckets: tuple[str, ...] = ("0", "1", "2", "3", "4", "5", "5+")) -> DataFrame:
    """Cross-table of expected and prescribed counts in buckets."""
    out = evaluated.groupBy("expected_bucket").pivot("prescribed_bucket", list(buckets)).count().fillna(0)
    return out


def set_recall(expected: Column, predicted: Column) -> Column:
    """Share of distinct expected tokens found; 1 for two empty sets, 0 for an empty expected one alone."""
    e, p = F.array_distinct(expected), F.array_distinct(predicted)
    return F.when(F.size(e) > 0, F.size(F.array_intersect(e, p)) / F.size(e)).otherwise(F.when(F.size(p) == 0, 1.0).otherwise(0.0))


def run_comparison(joined: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """Averages of two runs over the same cases from recall_old, recall_new, expected_n, old_n, new_n, old_extra and new_extra."""
    change = F.col("recall_new") - F.col("recall_old")
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return joined.agg(
        F.count("*").alias("cases"),
        mean("recall_old", "recall_old"),
        mean("recall_new", "recall_new"),
        mean(change, "recall_change"),
        mean(F.abs(F.col("old_n") - F.col("expected_n")), "size_error_old"),
        mean(F.abs(F.col("new_n") - F.col("expected_n")), "size_error_new"),
        mean("old_extra", "extra_old"),
        mean("new_extra", "extra_new"),
        F.count_if(change > epsilon).alias("improved"),
        F.count_if(change < -epsilon).alias("regressed"),
        F.count_if(F.abs(change) <= epsilon).alias("unchanged"),
    )


def latest_records(records: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One record a key, the last by ordinal."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("s")).select(key, "s.*")


def without_prompts(records: DataFrame, column: str = "res", fields: tuple[str, ...] = ("prompt", "entity_matrix")) -> tuple[DataFrame, DataFrame]:
    """A light table without bulky nested fields, and the audit table that keeps them with the case number."""
    there = [f for f in fields if f in records.schema[column].dataType.fieldNames()]
    light = records.withColumn(column, F.col(column).dropFields(*there)) if there else records
    keep = [c for c in ("runId", "caseNo", "prompts") if c in records.columns]
    audit = records.select(*keep, *(F.col(f"{column}.{f}").alias(f) for f in there))
    return light.drop("prompts"), audit


def _names(medicines: Column, field: str, lower: bool) -> Column:
    value = lambda m: F.lower(m[field]) if lower else m[field]
    return F.array_distinct(F.filter(F.transform(medicines, value), lambda x: F.coalesce(x != "", F.lit(False))))


def compare_runs(old: DataFrame, new: DataFrame, key: str = "case_no") -> DataFrame:
    """One row a case of both runs: recall of molecules and dosage groups, sizes, and what was matched, missed and extra.

    Runs have the key, expected and medications (arrays of structs with
    canonical_molecule and dosage_group_id); cases without medications in
    either are left out.  What is expected, visit_type and past_count are the
    old run's.
    """
    kept = [c for c in ("visit_type", "past_count") if c in old.columns]
    a = old.where("medications is not null").select(key, "expected", F.col("medications").alias("old"), *kept)
    both = a.join(new.where("medications is not null").select(key, F.col("medications").alias("new")), key)
    empty = F.array().cast(old.schema["expected"].dataType)
    both = both.withColumn("expected", F.coalesce("expected", empty))
    for name, column in (("expected", "e"), ("old", "o"), ("new", "n")):
        both = both.withColumns({f"__{column}": _names(F.col(name), "canonical_molecule", True), f"__{column}g": _names(F.col(name), "dosage_group_id", False)})
    out = both.withColumns(
        {
            "recall_old": set_recall(F.col("__e"), F.col("__o")),
            "recall_new": set_recall(F.col("__e"), F.col("__n")),
            "group_recall_old": set_recall(F.col("__eg"), F.col("__og")),
            "group_recall_new": set_recall(F.col("__eg"), F.col("__ng")),
            "expected_n": F.size("expected"),
            "old_n": F.size("old"),
            "new_n": F.size("new"),
            "matched": F.array_sort(F.array_intersect("__e", "__n")),
            "missed": F.array_sort(F.array_except("__e", "__n")),
            "extra": F.array_sort(F.array_except("__n", "__e")),
            # without expected molecules all predicted ones are extra, as in a comparison of sets
            "old_extra": F.size(F.array_except("__o", "__e")),
            "new_extra": F.size(F.array_except("__n", "__e")),
        }
    )
    return out.drop("expected", "old", "new", *(f"__{c}{g}" for c in "eon" for g in ("", "g")))


def recall_by(compared: DataFrame, group: Column, name: str = "cohort") -> DataFrame:
    """Mean recall of both runs, in percent, and cases by a grouping column; rows without a group are left out."""
    return compared.where(group.isNotNull()).groupBy(group.alias(name)).agg(F.count("*").alias("cases"), F.round(F.avg("recall_old") * 100, 1).alias("recall_old"), F.round(F.avg("recall_new") * 100, 1).alias("recall_new"))


def by_history(compared: DataFrame) -> DataFrame:
    return recall_by(compared, F.when(F.coalesce("past_count", F.lit(0)) > 0, "with past cases").otherwise("without past cases"))


def most_common(compared: DataFrame, column: str, n: int = 15) -> DataFrame:
    """The ``n`` most frequent entries of an array column, missed or extra: (molecule, cases)."""
    return compared.select(F.explode(column).alias("molecule")).groupBy("molecule").agg(F.count("*").alias("cases")).orderBy(F.desc("cases"), "molecule").limit(n)


def size_mismatches(compared: DataFrame, key: str = "case_no", least: int = 3) -> DataFrame:
    """Cases whose new regimen is larger or smaller than expected by ``least`` or more, the largest difference first."""
    gap = F.col("new_n") - F.col("expected_n")
    return compared.where(F.abs(gap) >= least).select(key, "expected_n", "new_n", gap.alias("difference")).orderBy(F.abs(F.col("difference")).desc(), key)


def most_improved(compared: DataFrame, key: str = "case_no", n: int = 10) -> DataFrame:
    change = F.col("recall_new") - F.col("recall_old")
    return compared.where(change > 0).select(key, F.round(change, 4).alias("change"), "matched", "missed").orderBy(F.desc("change"), key).limit(n)


def zero_scores(compared: DataFrame, key: str = "case_no") -> DataFrame:
    """Cases of which the new run found nothing that was expected."""
    return compared.where((F.col("recall_new") == 0) & (F.col("expected_n") > 0)).select(key, "expected_n", "new_n", "missed", "extra").orderBy(key)


def run_summary(compared: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """``run_comparison`` with the mean recall of dosage groups beside it."""
    groups = compared.agg(F.round(F.avg("group_recall_old"), 4).alias("group_recall_old"), F.round(F.avg("group_recall_new"), 4).alias("group_recall_new"))
    return run_comparison(compared, epsilon).crossJoin(groups)  # one row each


def top_items(items: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of ``one_vs_rest`` by support."""
    return items.orderBy(F.desc("support"), "item").limit(n)


def split_sizes(records: DataFrame, light: DataFrame, audit: DataFrame) -> DataFrame:
    """Bytes of JSON lines before and after a split, of the audit table, and the share saved: what a dry run reports."""
    size = lambda df, name: df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias(name))
    whole = size(records, "bytes_before").crossJoin(size(light, "bytes_light")).crossJoin(size(audit, "bytes_audit"))  # one row each
    before = F.col("bytes_before")
    return whole.withColumn("saved_percent", F.when(before > 0, F.round((before - F.col("bytes_light")) / before * 100, 1)).otherwise(0.0))
