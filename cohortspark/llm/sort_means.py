"""Centroid clustering by sort-means, in exact integers.

Each round orders, for every centroid, the other centroids by their distance
from it.  A vector starts at the centroid of its last round and meets the
others in that order, stopping strictly beyond twice its distance from where
it started: by the triangle inequality no later centroid can be nearer, and
one at exactly twice the distance may still tie.

A round is one pass that assigns and writes vectors with their cluster, and
one that sums them, a partial sum per cluster and task before the shuffle.
The driver holds the centroids alone, whose number is a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, table

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Largest size of a scaled component: squared distances of up to 1,024 of them, and four times those, fit a long.
LARGEST = 1 << 24
STATE = "__vec long, v array<int>, cluster int, distance long"


def scaled_vectors(rows: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, id: str = "vec_id") -> DataFrame:
    """(__vec, v, cluster, distance): vectors of ``dimensions`` finite components, each floor(scale * x), as yet in cluster 0."""
    whole = F.coalesce((F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < LARGEST)), F.lit(False))
    kept = F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))
    return rows.select(F.col(id).cast("long").alias("__vec"), kept.alias("v"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("v is not null")


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:id``, in that order; rows without an id are none."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__vec").cast("string")), 256)
    rows = vectors.where("__vec is not null").select(hashed.alias("h"), "v").orderBy("h", "v").limit(count).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def nearest(x: np.ndarray, start: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of ``x`` (ties: the smaller number) and its squared distance, scanning from ``start``."""
    square = lambda a, b: ((a - b) ** 2).sum(axis=-1)
    own = square(x, centroids[start])
    best, found = own.copy(), start.copy()
    for c in np.unique(start):
        gaps = square(centroids, centroids[c])
        rows = np.flatnonzero(start == c)
        rows = rows[np.argsort(-own[rows], kind="stable")]  # those that scan furthest come first
        reach = -own[rows]
        for other in np.argsort(gaps, kind="stable"):
            if other == c:
                continue
            n = np.searchsorted(reach, gaps[other] // -4, side="right")  # gap <= 4 * own
            if n == 0:
                break
            met = rows[:n]
            d = square(x[met], centroids[other])
            nearer = (d < best[met]) | ((d == best[met]) & (other < found[met]))
            best[met[nearer]], found[met[nearer]] = d[nearer], other
    return found, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _assigning(centroids: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, best = nearest(_matrix(batch.column("v"), centroids.shape[1]), batch.column("cluster").to_numpy().astype(np.int64), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("__vec"), batch.column("v"), pa.array(found.astype(np.int32)), pa.array(best)], ["__vec", "v", "cluster", "distance"])

    return run


def _summing(shape: tuple[int, int]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape, dtype=np.int64), np.zeros(shape[0], dtype=np.int64)
        for batch in batches:
            x, at = _matrix(batch.column("v"), shape[1]), batch.column("cluster").to_numpy()
            for c in np.unique(at):
                total[c] += x[at == c].sum(axis=0)
            count += np.bincount(at, minlength=shape[0])
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floor(sum / count) of each component, as exact integers; empty clusters keep theirs."""
    parts = map_arrow(state.select("v", "cluster"), _summing(centroids.shape), "cluster int, n long, sums array<long>")
    long = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    out = centroids.copy()
    for row in long.groupBy("cluster", "i").agg(whole("s").alias("s"), F.sum("n").alias("n")).collect():
        out[row.cluster, row.i] = int(row.s) // row.n
    return out


def clusters(rows: DataFrame, vector: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, id: str = "vec_id") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector that takes part, and the final centroids.

    Vectors of another length, null ones, and ones with a null or non-finite
    component take no part; nor do components of LARGEST / scale and more,
    whose distances would not fit a long.  Equal vectors, ties and rows that
    repeat are assigned alike; of equal centroids the first takes all.  Rows
    without an id are assigned, but start no centroid.  With fewer vectors
    than ``count`` there are fewer centroids; with none the result is empty.
    Other columns are not read.
    """
    if dimensions > 1024:
        raise ValueError("distances of more than 1,024 components might not fit a long")
    scratch = Scratch(rows.sparkSession, "sort_means")
    state = scaled_vectors(rows, vector, dimensions, scale, id)
    centroids = first_centroids(state, count, seed)
    if not len(centroids):
        return state.limit(0).select(F.col("__vec").alias(id), "cluster", "distance"), centroids
    for done in range(rounds + 1):
        last, state = state, scratch.save(map_arrow(state, _assigning(centroids), STATE))
        scratch.keep_only(state)
        if done == rounds:
            break
        moved = _means(state, centroids)
        if (moved == centroids).all():  # every further round would be the same
            break
        centroids = moved
    return state.select(F.col("__vec").alias(id), "cluster", "distance"), centroids


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia (both null beyond a long) and centroid_sha256."""
    spark = assigned.sparkSession
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    each = [(c, fits(s), fits(sum(sums.values())), digest(c)) for c, s in sorted(sums.items())]
    named = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = described(*clusters(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        d = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT)"
        steps.append(f"a{r} AS (SELECT vec_id, any_value(v) AS v, min({{'d': {d}, 'k': k}}) AS b FROM v, c{r} GROUP BY vec_id)")
        if r < ROUNDS:
            flat = f"SELECT b.k AS k, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{r}"
            mean = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
            steps.append(f"m{r} AS (SELECT k, list(x ORDER BY i) AS c FROM (SELECT k, i, {mean} AS x FROM ({flat}) GROUP BY k, i) GROUP BY k)")
            steps.append(f"c{r + 1} AS (SELECT c{r}.k AS k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.k = m{r}.k)")
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS k, v AS c FROM v QUALIFY k < 16),
{", ".join(steps)}
SELECT vec_id, b.k AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON b.k = c{ROUNDS}.k
"""


ORACLE = _oracle()
