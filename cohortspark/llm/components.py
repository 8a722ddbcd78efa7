"""Connected components by alternating large and small stars, as DataFrame joins.

Each round rewrites the edge table so that nodes point to ever smaller ids;
the number of rounds is logarithmic in the number of nodes for the graphs met
in practice.  Edges never reach the driver; each round is written to the
shared scratch folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least neighbour of their ``u``.

    The second key makes both sides shuffle for this join alone, so that the
    edges of a star's centre can be split among tasks at run time.
    """
    return edges.withColumn("k", F.xxhash64("u")).join(least.withColumn("k", F.xxhash64("u")), ["u", "k"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return _met(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("u > v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _met(down, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node of its own to a root, so that the edges are stars around least nodes."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    chained = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return several.unionByName(chained).isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``, root being the smallest node reachable.

    Self loops and nulls are ignored; an empty edge table gives an empty result.
    Raises when ``rounds`` do not suffice, rather than return wrong roots.
    """
    now = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    for _ in range(rounds):
        if _settled(now):
            break
        after = scratch.save(_small_star(_large_star(now)))
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
