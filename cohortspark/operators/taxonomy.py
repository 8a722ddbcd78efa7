"""Taxonomies: depths, ancestors and Wu-Palmer similarity, from an edge table (child, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

LEVELS = 64
GENERIC_DEPTH = 2


def edges_of(terms: DataFrame) -> DataFrame:
    """(child, parent) of terms that are not obsolete; parents may be named by alternative ids, those that are no term are dropped."""
    live = terms.where(~F.col("is_obsolete"))
    pairs = live.select(F.col("id").alias("child"), F.explode("parents").alias("given"))
    codes = canonical_codes(live) if "alt_ids" in terms.columns else live.select(F.col("id").alias("given"), F.col("id").alias("code"))
    return pairs.join(codes, "given").select("child", F.col("code").alias("parent")).where("child <> parent").distinct()


def ancestor_closure(nodes: DataFrame, edges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(code, ancestor, steps): every ancestor with the longest way to it, a node being its own at 0 steps.

    Grows by one level a round until nothing is added; a cycle makes it fail.
    Tables meet by sorting, as a broadcast each round would send them to the driver.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    own = nodes.select(F.col("code"), F.col("code").alias("ancestor"), F.lit(0).alias("steps"))
    closure, front = own, own
    for level in range(1, levels + 1):
        front = front.join(edges.hint("merge"), F.col("ancestor") == F.col("child")).select("code", F.col("parent").alias("ancestor")).distinct().withColumn("steps", F.lit(level)).checkpoint()
        if front.isEmpty():
            return closure.groupBy("code", "ancestor").agg(F.max("steps").alias("steps"))
        closure = closure.unionByName(front)
    raise ValueError(f"the taxonomy is deeper than {levels} levels or has a cycle")


def depths(closure: DataFrame) -> DataFrame:
    """(code, depth): the longest way to a root, roots having 1."""
    return closure.groupBy("code").agg((F.max("steps") + 1).alias("depth"))


def specific_ancestors(closure: DataFrame, generic_depth: int = GENERIC_DEPTH) -> DataFrame:
    """(code, ancestor, ancestor_depth) without the generic ancestors near the root."""
    d = depths(closure).select(F.col("code").alias("ancestor"), F.col("depth").alias("ancestor_depth"))
    return closure.select("code", "ancestor").join(d, "ancestor").where(F.col("ancestor_depth") > generic_depth).select("code", "ancestor", "ancestor_depth")


def canonical_codes(terms: DataFrame) -> DataFrame:
    """(given, code): every id and alternative id with the id it stands for; an id stands for itself, whatever lists it as alternative."""
    own = terms.select(F.col("id").alias("given"), F.col("id").alias("code"))
    other = terms.select(F.explode("alt_ids").alias("given"), F.col("id").alias("code")).groupBy("given").agg(F.min("code").alias("code"))
    return own.unionByName(other.join(own.select("given"), "given", "left_anti"))


def canonicalized(rows: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """``rows`` with the codes in ``column`` replaced by the ids they stand for; unknown codes stay."""
    codes = canonical_codes(terms).select(F.col("given").alias("__given"), F.col("code").alias("__code"))
    joined = rows.join(codes, F.col(column) == F.col("__given"), "left")
    return joined.withColumn(column, F.coalesce("__code", column)).drop("__given", "__code")


def wu_palmer(pairs: DataFrame, closure: DataFrame, generic_depth: int = GENERIC_DEPTH) -> DataFrame:
    """``pairs`` (a, b) with wu_palmer: 2 * depth of the deepest common ancestor over the sum of depths.

    1 for equal known codes; 0 for unknown codes and where only generic
    ancestors are common.
    """
    d, up = depths(closure), specific_ancestors(closure, generic_depth)
    distinct = pairs.select("a", "b").distinct()
    left, right = up.withColumnRenamed("code", "a"), up.select(F.col("code").alias("b"), "ancestor")
    common = distinct.join(left, "a").join(right, ["b", "ancestor"]).groupBy("a", "b").agg(F.max("ancestor_depth").alias("common"))
    da, db = d.select(F.col("code").alias("a"), F.col("depth").alias("da")), d.select(F.col("code").alias("b"), F.col("depth").alias("db"))
    joined = pairs.join(common, ["a", "b"], "left").join(da, "a", "left").join(db, "b", "left")
    known = F.col("da").isNotNull() & F.col("db").isNotNull()
    value = F.when(~known, 0.0).when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce(2.0 * F.col("common") / (F.col("da") + F.col("db")), F.lit(0.0)))
    return joined.withColumn("wu_palmer", value).drop("common", "da", "db")


def related_codes(left: DataFrame, right: DataFrame, closure: DataFrame, generic_depth: int = GENERIC_DEPTH) -> DataFrame:
    """(a, b, wu_palmer) of the codes of ``left`` (a) and ``right`` (b) with a common ancestor that is not generic; all others have 0.

    Codes meet at their common ancestors, so that those with none are never paired.
    """
    d, up = depths(closure), specific_ancestors(closure, generic_depth)
    a = left.distinct().join(up.withColumnRenamed("code", "a"), "a")
    b = right.distinct().join(up.select(F.col("code").alias("b"), "ancestor"), "b")
    common = a.join(b, "ancestor").groupBy("a", "b").agg(F.max("ancestor_depth").alias("common"))
    joined = common.join(d.withColumnsRenamed({"code": "a", "depth": "da"}), "a").join(d.withColumnsRenamed({"code": "b", "depth": "db"}), "b")
    return joined.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0 * F.col("common") / (F.col("da") + F.col("db"))).alias("wu_palmer"))


def updated_closure(closure: DataFrame, nodes: DataFrame, edges: DataFrame, old_edges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``ancestor_closure(nodes, edges)``, made from the ``closure`` of an earlier release with ``old_edges``.

    Only codes at or below a changed edge, new codes and those below a removed
    one get their ancestors anew; they climb the new edges until they meet a
    code that is none of these, whose stored ancestors are taken over whole.
    All other rows stay as they are.  A cycle makes it fail.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    # each is read in every round
    closure, now = closure.checkpoint(), edges.select("child", "parent").distinct().checkpoint()
    before = old_edges.select("child", "parent").distinct()
    changed = now.exceptAll(before).unionByName(before.exceptAll(now)).select(F.col("child").alias("ancestor")).distinct()
    known = closure.where("steps = 0").select("code")
    gone = known.join(nodes.select("code").hint("merge"), "code", "left_anti").select(F.col("code").alias("ancestor"))
    below = closure.join(changed.unionByName(gone).distinct().hint("merge"), "ancestor", "left_semi").select("code")
    fresh = nodes.select("code").join(known.hint("merge"), "code", "left_anti")
    affected = below.unionByName(fresh).distinct().join(nodes.select("code").hint("merge"), "code", "left_semi").checkpoint()
    kept = closure.join(below.distinct().hint("merge"), "code", "left_anti").checkpoint()
    climbing = affected.select("code", F.col("code").alias("at"))
    found = affected.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("steps"))
    mark = affected.select(F.col("code").alias("at"), F.lit(True).alias("open"))
    for level in range(1, levels + 1):
        above = climbing.join(now.hint("merge"), F.col("at") == F.col("child")).select("code", F.col("parent").alias("at")).distinct().join(mark.hint("merge"), "at", "left").checkpoint()
        if above.isEmpty():
            return kept.unionByName(found.groupBy("code", "ancestor").agg(F.max("steps").alias("steps")))
        climbing = above.where("open").select("code", "at")
        settled = above.where("open is null").join(kept.withColumnRenamed("code", "at").hint("merge"), "at").select("code", "ancestor", (F.col("steps") + level).alias("steps"))
        found = found.unionByName(climbing.select("code", F.col("at").alias("ancestor"), F.lit(level).alias("steps"))).unionByName(settled)
    raise ValueError(f"the taxonomy is deeper than {levels} levels or has a cycle")
