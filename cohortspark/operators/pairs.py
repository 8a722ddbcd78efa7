"""Pairs of entities, made from data: query entities against the entities of candidate cases.

Similarities are computed once for each pair of distinct entities, whatever
the number of cases that share them, and then met by cases through equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import ensure_checkpoint_dir
from .cosine_join import cosine_pairs
from .similarity import deduplicated, entity_key
from .taxonomy import related_codes


def entities(rows: DataFrame, owner: list[str], column: str, vectors: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """(owner, pos, term, code, embedding) of an array of structs that has at least ``term``; each entity of an owner once.

    ``vectors`` (vector_id, embedding) may give the vectors that the field
    vector_id names; they are joined last, so that no vector is shuffled once
    for each owner that has it.  ``path`` may name a folder to keep the
    entities in (without the vectors joined), as most uses read them several times.
    """
    fields = rows.schema[column].dataType.elementType.fieldNames()
    long = rows.select(*owner, F.posexplode(column).alias("pos", "e"))
    given = lambda name, kind: F.col(f"e.{name}").cast(kind) if name in fields else F.lit(None).cast(kind)
    named = long.select(*owner, "pos", given("term", "string").alias("term"), given("code", "string").alias("code"), *([given("embedding", "array<double>").alias("embedding")] if vectors is None else [F.col("e.vector_id")]))
    kept = deduplicated(named, owner)
    if path is not None:
        kept.write.parquet(path)
        kept = rows.sparkSession.read.parquet(path)
    return kept if vectors is None else with_vectors(kept, vectors)


def with_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """``rows`` with the embedding that each one's vector_id names, null if there is none, in its place."""
    kept = vectors.select("vector_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.join(kept, "vector_id", "left").drop("vector_id")


def _identity() -> Column:
    """What makes two entities the same for a similarity: the term, letters' case and outer blanks aside, the code and the vector."""
    return F.struct(F.lower(F.trim("term")).alias("t"), F.coalesce("code", F.lit("")).alias("c"), F.xxhash64("embedding").alias("v"))


def _distinct(rows: DataFrame, side: str) -> DataFrame:
    first = rows.groupBy(_identity().alias(side)).agg(F.first(F.struct("term", "code", "embedding")).alias(f"{side}_e"))
    return first


def distinct_pairs(left: DataFrame, right: DataFrame, closure: DataFrame | None = None, generic_depth: int = 2, least: float = 0.0) -> DataFrame:
    """(l, r, same_term, same_code, both_codes, cos, lca) of distinct entities of ``left`` and ``right`` that are like each other.

    Pairs have an equal term or code, a specific common ancestor in
    ``closure``, or a cosine of at least ``least`` (above 0 if that is 0); all
    others have neither likeness.  Each of these is a join of its own, by
    term, code, ancestor or the rings of ``cosine_pairs``.  ``lca`` is
    Wu-Palmer, null where a code is missing or there is no taxonomy.
    """
    ensure_checkpoint_dir(left.sparkSession)
    a, b = _distinct(left, "l").checkpoint(), _distinct(right, "r").checkpoint()
    met = cosine_pairs(a.select("l", "l_e.embedding"), b.select("r", "r_e.embedding"), least).where("cos > 0").checkpoint()
    low = lambda c: F.lower(F.trim(c))
    terms = a.select("l", low("l_e.term").alias("t")).join(b.select("r", low("r_e.term").alias("t")), "t").select("l", "r")
    a_codes, b_codes = a.select("l", F.col("l_e.code").alias("a")).where("a is not null"), b.select("r", F.col("r_e.code").alias("b")).where("b is not null")
    codes = a_codes.join(b_codes, F.col("a") == F.col("b")).select("l", "r")
    named = terms.unionByName(codes)
    related = None
    if closure is not None:
        related = related_codes(a_codes.select("a").distinct(), b_codes.select("b").distinct(), closure, generic_depth).checkpoint()
        named = named.unionByName(a_codes.join(related, "a").join(b_codes, "b").select("l", "r"))
    # pairs found by name only have a cosine below ``least``, which still counts in the mean with an ontology's likeness
    rest = named.distinct().join(met.select("l", "r"), ["l", "r"], "left_anti")
    vectors = lambda df, side: df.select(side, f"{side}_e")
    measured = rest.join(vectors(a, "l"), "l").join(vectors(b, "r"), "r").withColumn("cos", V.cosine(F.col("l_e.embedding"), F.col("r_e.embedding")))
    plain = lambda df, side: df.select(side, F.struct(f"{side}_e.term", f"{side}_e.code").alias(f"{side}_e"))
    every = met.join(plain(a, "l"), "l").join(plain(b, "r"), "r").unionByName(measured.withColumns({f"{s}_e": F.struct(f"{s}_e.term", f"{s}_e.code") for s in "lr"}))
    pairs = every.select(
        "l",
        "r",
        F.coalesce(low("l_e.term") == low("r_e.term"), F.lit(False)).alias("same_term"),
        F.coalesce(F.col("l_e.code") == F.col("r_e.code"), F.lit(False)).alias("same_code"),
        (F.col("l_e.code").isNotNull() & F.col("r_e.code").isNotNull()).alias("both_codes"),
        "cos",
        F.col("l_e.code").alias("a"),
        F.col("r_e.code").alias("b"),
    )
    if related is None:
        return pairs.withColumn("lca", F.lit(None).cast("double")).drop("a", "b")
    lca = F.when(F.col("both_codes") & ~F.col("same_code"), F.coalesce("wu_palmer", F.lit(0.0)))
    return pairs.join(related, ["a", "b"], "left").withColumn("lca", lca).drop("a", "b", "wu_palmer")


def similar_entities(pairs: DataFrame, alpha: float = V.ALPHA, tau: float = V.TAU) -> DataFrame:
    """(l, r, sim) of the pairs whose term similarity is above 0."""
    raw = F.when(F.col("both_codes"), alpha * F.greatest(F.col("cos"), F.lit(0.0)) + (1 - alpha) * F.coalesce("lca", F.lit(0.0))).otherwise(F.greatest(F.col("cos"), F.lit(0.0)))
    sim = F.when(F.col("same_term") | F.col("same_code"), F.lit(1.0)).otherwise(V.sharpen(raw, tau))
    return pairs.select("l", "r", sim.alias("sim")).where("sim > 0")


def set_similarities(queries: DataFrame, cases: DataFrame, query: list[str], case: list[str], closure: DataFrame | None = None, document_frequency: DataFrame | None = None, documents: int = 1000, beta: float = 0.5, alpha: float = V.ALPHA, tau: float = V.TAU, generic_depth: int = 2) -> DataFrame:
    """(query, case, set_similarity) for cases with an entity similar to one of the query's; for all others it is 0.

    ``queries`` and ``cases`` are ``entities`` under their keys.  Either side's
    entities are covered by the best of the other side, weighted by inverse
    document frequency (``document_frequency``: key, df; 1 where missing), and
    the two covers are mixed by ``beta``, the cases' share.
    """
    similar = similar_entities(distinct_pairs(queries, cases, closure, generic_depth, least=max(tau, 0.0)), alpha, tau)

    def weighted(rows: DataFrame, side: str) -> DataFrame:
        named = rows.withColumn(side, _identity()).withColumn("key", entity_key(F.col("term"), F.col("code")))
        named = named.join(document_frequency.select("key", "df"), "key", "left") if document_frequency is not None else named.withColumn("df", F.lit(1))
        return named.withColumn(f"{side}_w", V.idf_weight(F.col("df"), documents))

    q, c = weighted(queries, "l").select(*query, "l", "l_w"), weighted(cases, "r").select(*case, "r", "r_w")
    q_total, c_total = q.groupBy(*query).agg(F.sum("l_w").alias("l_total")), c.groupBy(*case).agg(F.sum("r_w").alias("r_total"))
    met = c.join(similar, "r").join(q, "l")
    by = [*query, *case]

    def cover(side: str) -> DataFrame:
        best = met.groupBy(*by, side).agg((F.max("sim") * F.max(f"{side}_w")).alias("s"))
        return best.groupBy(*by).agg(F.sum("s").alias(f"{side}_cover"))

    both = cover("l").join(cover("r"), by).join(q_total, query).join(c_total, case)
    value = (1 - beta) * F.col("l_cover") / F.col("l_total") + beta * F.col("r_cover") / F.col("r_total")
    return both.select(*by, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("set_similarity"))


def document_frequencies(cases: DataFrame, case: list[str]) -> DataFrame:
    """(key, df): how many cases have an entity of each key, for the weights of ``set_similarities``."""
    keyed = cases.select(*case, entity_key(F.col("term"), F.col("code")).alias("key")).distinct()
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("df"))


def evidence(queries: DataFrame, cases: DataFrame, query: list[str], case: list[str], closure: DataFrame | None = None, generic_depth: int = 2) -> DataFrame:
    """(query, case, lca, cos): every query entity against the entities of every case, pairs without any likeness left out.

    Equal terms count as 1 on both scales, equal codes as 1 on the ontology's.
    """
    pairs = distinct_pairs(queries, cases, closure, generic_depth)
    lca = F.when(F.col("same_term") | F.col("same_code"), F.lit(1.0)).otherwise(F.coalesce("lca", F.lit(0.0)))
    cos = F.when(F.col("same_term"), F.lit(1.0)).otherwise(F.greatest(F.col("cos"), F.lit(0.0)))
    like = pairs.select("l", "r", lca.alias("lca"), cos.alias("cos")).where("lca > 0 or cos > 0")
    q, c = queries.select(*query, _identity().alias("l")).distinct(), cases.select(*case, _identity().alias("r"))
    return c.join(like, "r").join(q, "l").select(*query, *case, "lca", "cos")
