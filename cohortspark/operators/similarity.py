"""Set similarity of encounters, and the search for similar cases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

ROW_BLOCK, QUERY_BLOCK = 8192, 4096
WEIGHTS = {"symptoms": 0.4, "diagnosis": 0.4, "demographic": 0.1, "visit": 0.1}


def entity_key(term: Column, code: Column) -> Column:
    return F.coalesce(F.concat(F.lit("code:"), code.cast("string")), F.concat(F.lit("term:"), F.lower(F.trim(term))))


def deduplicated(entities: DataFrame, owner: list[str], position: str = "pos") -> DataFrame:
    """The first entity of each key an owner has; blank terms are dropped."""
    rest = [c for c in entities.columns if c not in owner]
    named = entities.where(F.trim(F.coalesce("term", F.lit(""))) != "").withColumn("__key", entity_key(F.col("term"), F.col("code")))
    first = named.groupBy(*owner, "__key").agg(F.min_by(F.struct(*rest), position).alias("s"))
    return first.select(*owner, "s.*")


def set_similarity(pairs: DataFrame, by: list[str], beta: float = 0.5, weights: tuple[str, str] | None = None) -> DataFrame:
    """``by`` and set_similarity from pairs (q_key, c_key, sim): best matches of either side, averaged and mixed by ``beta``.

    ``pairs`` holds all pairs of one query set and one candidate set under
    ``by``; sets that are empty on a side have no pairs and so no row (null
    after a left join).  ``weights`` names the columns of the two sides'
    weights; without them all entities count alike.
    """
    qw, cw = (F.col(w) for w in weights) if weights else (F.lit(1.0), F.lit(1.0))

    def cover(key: str, weight: Column, name: str) -> DataFrame:
        best = pairs.groupBy(*by, key).agg(F.max("sim").alias("best"), F.max(weight).alias("w"))
        return best.groupBy(*by).agg((F.sum(F.col("best") * F.col("w")) / F.sum("w")).alias(name))

    both = cover("q_key", qw, "__q").join(cover("c_key", cw, "__c"), by)
    return both.select(*by, (beta * F.col("__q") + (1 - beta) * F.col("__c")).alias("set_similarity"))


def array_set_similarity(query: Column, candidate: Column, sim, beta: float = 0.5) -> Column:
    """The same within a row, for arrays and a function of two elements; null if either is empty."""
    best = lambda a, b, f: F.aggregate(F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: f(x, y)))), F.lit(0.0), lambda s, v: s + v) / F.size(a)
    value = beta * best(query, candidate, sim) + (1 - beta) * best(candidate, query, lambda x, y: sim(y, x))
    return F.when((F.size(query) > 0) & (F.size(candidate) > 0), value)


def capped_top(ranked: DataFrame, k: int, order: list[Column], case: str = "case_no") -> DataFrame:
    """The first ``k`` rows in order, at most max(1, k // 3) of a case; rows without a case are not capped.

    The cap depends only on the order within a case, so it can be taken there
    before the global cut, which is a distributed top-k.
    """
    place = F.row_number().over(Window.partitionBy(case).orderBy(*order))
    named = ranked.where(F.col(case).isNotNull()).withColumn("__place", place).where(F.col("__place") <= max(1, k // 3)).drop("__place")
    return named.unionByName(ranked.where(F.col(case).isNull())).orderBy(*order).limit(k)


def ranking_order(final: str = "final", diagnosis: str = "diagnosis_sim", symptoms: str = "symptom_sim", date: str = "visit_date", ident: str = "case_id") -> list[Column]:
    return [F.desc(final), F.coalesce(F.col(diagnosis), F.lit(-1.0)).desc(), F.coalesce(F.col(symptoms), F.lit(-1.0)).desc(), F.col(date).cast("string").desc(), F.col(ident)]


def similar_cases(query: dict, cases: DataFrame, symptom_sim: DataFrame, diagnosis_sim: DataFrame, k: int, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Ranked, capped similar cases for one query (age, gender, visit_type).

    ``cases`` has case_id, case_no, age, gender, visit_reason and visit_date;
    the similarity tables have case_id and set_similarity.
    """
    if sum(weights.values()) <= 0:
        raise ValueError("the weights must sum to more than 0")
    joined = cases.join(symptom_sim.withColumnRenamed("set_similarity", "symptom_sim"), "case_id", "left").join(diagnosis_sim.withColumnRenamed("set_similarity", "diagnosis_sim"), "case_id", "left")
    demographic = V.demographic_similarity(F.lit(query.get("age")), F.col("age"), F.lit(query.get("gender")), F.col("gender"))
    visit = V.visit_type_similarity(F.lit(query.get("visit_type")), F.col("visit_reason"))
    parts = [(F.col("symptom_sim"), weights["symptoms"]), (F.col("diagnosis_sim"), weights["diagnosis"]), (demographic, weights["demographic"]), (visit, weights["visit"])]
    scored = joined.withColumns({"demographic_sim": demographic, "visit_sim": visit, "final": F.round(V.composite(parts), 4)})
    return capped_top(scored, k, ranking_order())


def _block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order, their unit vectors and lengths; a vector that has no cosine is zero."""
    rows = rows.sort_by("vec_id")
    lengths = rows.column("n").to_numpy()
    unit = np.zeros((len(lengths), max(lengths, default=0)))
    for n in set(lengths.tolist()) - {0}:
        at = np.flatnonzero(lengths == n)
        x = rows.filter(pa.array(lengths == n)).column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
        size = np.sqrt((x * x).sum(axis=1))[:, None]
        unit[at, :n] = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    return rows.column("vec_id").to_numpy(), unit, lengths


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` of the largest cosine for every row of ``queries``, by comparing all.

    Both have vec_id and embedding.  Scores have four digits, ties go to the
    smaller vec_id, a query's own vec_id is left out and rows without a vec_id
    take no part.  The cosine is 0 where a vector is null or zero, holds null
    or non-finite components, or has another length than the query.  Blocks of
    queries meet blocks of rows, so neither side has to fit in one task.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.when(finite, v).otherwise(F.array().cast("array<double>"))
    shaped = lambda df: df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(usable, F.array().cast("array<double>")).alias("v")).withColumn("n", F.size("v"))
    rows, asked = shaped(vectors), shaped(queries)
    n_rows, n_asked = rows.count(), asked.count()
    row_blocks = -(-n_rows // max(1, min(row_block, -(-n_rows // 64)))) or 1  # 64 blocks at least, if there are as many rows
    query_blocks = -(-n_asked // query_block) or 1
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", dealt(query_blocks).alias("qb")).select("*", every(row_blocks).alias("rb"))
    right = rows.select("*", dealt(row_blocks).alias("rb")).select("*", every(query_blocks).alias("qb"))

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        (q_ids, qs, q_n), (r_ids, rs, r_n) = _block(q), _block(r)
        width = max(qs.shape[1], rs.shape[1])
        qs, rs = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (qs, rs))
        out = []
        for at in range(0, len(q_ids) if len(r_ids) else 0, 256):
            ids = q_ids[at : at + 256]
            cosine = np.where(q_n[at : at + 256, None] == r_n[None, :], qs[at : at + 256] @ rs.T, 0.0)
            score = (np.sign(cosine) * np.floor(np.abs(cosine) * 10_000 + 0.5)).astype(np.int64)  # half away from zero, as SQL rounds
            own = ids[:, None] == r_ids[None, :]
            order = np.where(own, np.iinfo(np.int64).max, (10_000 - score) * len(r_ids) + np.arange(len(r_ids)))
            first = np.argpartition(order, min(k, len(r_ids)) - 1, axis=1)[:, :k]
            i, j = np.repeat(np.arange(len(ids)), first.shape[1]), first.reshape(-1)
            i, j = i[~own[i, j]], j[~own[i, j]]
            out.append(pa.table({"query_id": ids[i], "vec_id": r_ids[j], "score": score[i, j] / 10_000}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(best, "query_id long, vec_id long, score double")
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
