"""Pairs of vectors whose cosine reaches a threshold, by angles to a few pivots.

Angles obey the triangle inequality: two vectors within an angle of each
other have angles to any pivot that differ by no more.  The rows of one side
are posted in rings, by their nearest pivot and their angle to it; each ring
keeps the range of its rows' angles to every pivot.  A vector of the other
side goes only to rings that it may reach from all pivots, which loses no
pair.  Rings, and the vectors that reach one, are cut into blocks, and blocks
are compared by one matrix product a task; the cosines of the pairs found are
then summed in the order of the components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

PIVOTS, SAMPLE, RINGS = 8, 512, 32
BLOCK = 4096
SLACK = 1e-9
#: Rows of one product, and the share of pairs (one in so many) from which all of a block's cosines are computed.
TILE, DENSE = 512, 8


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(column: pa.Array) -> np.ndarray:
    x = _matrix(column)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _sizes(x: np.ndarray) -> np.ndarray:
    total = np.zeros(x.shape[1])
    for c in x:
        total += c * c
    return np.sqrt(total)


def _in_order(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of columns ``i`` of ``q`` with columns ``j`` of ``x``, summed one component after the other as ``vectors.dot`` does.

    A matrix product sums in an order that depends on its shape, so that the
    last digits of equal pairs differ and ties fall apart.
    """
    if len(i) * DENSE < q.shape[1] * x.shape[1]:
        total = np.zeros(len(i))
        for a, b in zip(q, x, strict=True):
            total += a[i] * b[j]
        return total
    every, product = np.zeros((q.shape[1], x.shape[1])), np.empty((q.shape[1], TILE))
    for at in range(0, x.shape[1], TILE):
        part = every[:, at : at + TILE]
        for a, b in zip(q, x[:, at : at + TILE], strict=True):
            part += np.multiply.outer(a, b, out=product[:, : len(b)])
    return every[i, j]


def _usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v, n): vectors of finite components that have a length, at most 1e150 in size so that it doesn't overflow."""
    v = F.col(vector).cast("array<double>")
    fits = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) <= 1e150)) & F.exists(v, lambda x: F.abs(x) > 1e-150)
    return rows.select(id, F.when(fits, v).alias("v")).where("v is not null").withColumn("n", F.size("v"))


def _pivots(rows: DataFrame, count: int, sample: int) -> np.ndarray:
    """Vectors far from each other, out of at most ``sample`` rows taken by hash."""
    taken = [r.v for r in rows.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).collect()]
    x = np.array(taken)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def _angles(batch: pa.RecordBatch, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(batch.column("v")) @ pivots.T, -1.0, 1.0))


def _posting(pivots: np.ndarray, rings: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(batch, pivots)
                home = angles.argmin(axis=1)
                ring = home * rings + np.minimum((angles.min(axis=1) * (rings / math.pi)).astype(np.int64), rings - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ring.astype(np.int32)), pa.array(list(angles))], names=[*batch.schema.names, "ring", "angles"])

    return run


def _reaching(pivots: np.ndarray, numbers: list[int], low: np.ndarray, high: np.ndarray, reach: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(batch, pivots)
                reached = np.ones((len(angles), len(numbers)), dtype=bool)
                for p in range(len(pivots)):
                    at = angles[:, p, None]
                    reached &= (at + reach >= low[None, :, p]) & (at - reach <= high[None, :, p])
                named = np.array(numbers, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([named[r] for r in reached], pa.list_(pa.int32()))], names=[*batch.schema.names, "rings"])

    return run


def cosine_pairs(left: DataFrame, right: DataFrame, threshold: float, l: str = "l", r: str = "r", vector: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:  # noqa: E741
    """(l, r, cos): ids of ``left`` and ``right`` whose vectors have a cosine of at least ``threshold`` (less SLACK for rounding).

    Vectors that are null, zero, hold null or non-finite components or have
    different lengths have no cosine and are in no pair.  Ids that repeat give
    pairs each; a null id stays.  An empty side gives no rows.
    """
    ensure_checkpoint_dir(left.sparkSession)
    a, b = _usable(left, l, vector), _usable(right, r, vector).checkpoint()
    out = None
    for n in sorted(x.n for x in b.select("n").distinct().collect()):  # one length, as a rule
        part = _of_length(a.where(F.col("n") == n).drop("n"), b.where(F.col("n") == n).drop("n"), threshold, l, r, pivots, block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return left.select(l).limit(0).join(right.select(r).limit(0), F.lit(False)).withColumn("cos", F.lit(0.0))
    return out


class _Rings(NamedTuple):
    """Both sides posted to rings: ``right`` (r, v, ring), ``left`` (l, v, rings), and the rows of each per ring."""

    left: DataFrame
    right: DataFrame
    rows: dict[int, int]
    asked: dict[int, int]


def _dealt_to_rings(left: DataFrame, right: DataFrame, threshold: float, l: str, r: str, pivots: int) -> _Rings:  # noqa: E741
    chosen = _pivots(right, pivots, SAMPLE)
    kind_l, kind_r = (df.schema[name].dataType.simpleString() for df, name in ((left, l), (right, r)))
    posted = right.mapInArrow(_posting(chosen, RINGS), f"{r} {kind_r}, v array<double>, ring int, angles array<double>").checkpoint()
    bounds = [f(F.col("angles")[p]).alias(f"{name}{p}") for p in range(len(chosen)) for name, f in (("low", F.min), ("high", F.max))]
    cells = posted.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), *bounds).collect()  # at most PIVOTS * RINGS
    low, high = (np.array([[c[f"{name}{p}"] for p in range(len(chosen))] for c in cells]) for name in ("low", "high"))
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-7
    reached = left.mapInArrow(_reaching(chosen, [c.ring for c in cells], low, high, reach), f"{l} {kind_l}, v array<double>, rings array<int>").checkpoint()
    asked = {x.ring: x.n for x in reached.select(F.explode("rings").alias("ring")).groupBy("ring").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _Rings(reached, posted.drop("angles"), {c.ring: c.n for c in cells}, asked)


def compared_pairs(left: DataFrame, right: DataFrame, threshold: float, l: str = "l", r: str = "r", vector: str = "embedding", pivots: int = PIVOTS) -> tuple[int, int]:  # noqa: E741
    """How many pairs ``cosine_pairs`` compares, and how many there are of equal length."""
    ensure_checkpoint_dir(left.sparkSession)
    a, b = _usable(left, l, vector), _usable(right, r, vector).checkpoint()
    met = every = 0
    for n in sorted(x.n for x in b.select("n").distinct().collect()):
        rings = _dealt_to_rings(a.where(F.col("n") == n).drop("n"), b.where(F.col("n") == n).drop("n"), threshold, l, r, pivots)
        met += sum(n * rings.rows[ring] for ring, n in rings.asked.items())
        every += rings.left.count() * sum(rings.rows.values())
    return met, every


def _of_length(left: DataFrame, right: DataFrame, threshold: float, l: str, r: str, pivots: int, block: int) -> DataFrame:  # noqa: E741
    rings = _dealt_to_rings(left, right, threshold, l, r, pivots)
    size = [(ring, -(-rings.rows[ring] // block), -(-n // block)) for ring, n in rings.asked.items()]
    blocks = F.broadcast(left.sparkSession.createDataFrame(size, "ring int, rbs int, qbs int"))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ls = rings.left.select(l, "v", F.explode("rings").alias("ring")).join(blocks, "ring").select(F.col(l), "v", "ring", dealt(l, "qbs").alias("qb"), every("rbs").alias("rb"))
    rs = rings.right.join(blocks, "ring").select(F.col(r), "v", "ring", dealt(r, "rbs").alias("rb"), every("qbs").alias("qb"))
    keys = ["ring", "qb", "rb"]

    def compare(q: pa.Table, x: pa.Table) -> pa.Table:
        kind = pa.schema([q.schema.field(l), x.schema.field(r), pa.field("cos", pa.float64())])
        found = []
        if q.num_rows and x.num_rows:
            vectors, ids = x.column("v").combine_chunks(), x.column(r).combine_chunks()
            xs, columns = _unit(vectors), _matrix(vectors).T.copy()
            sizes = _sizes(columns)
            for at in range(0, q.num_rows, 256):
                some = q.slice(at, 256).combine_chunks()
                asked = some.column("v").combine_chunks()
                i, j = np.nonzero(_unit(asked) @ xs.T >= threshold - SLACK)
                mine = _matrix(asked).T.copy()
                cos = _in_order(mine, columns, i, j) / (_sizes(mine)[i] * sizes[j])
                found.append(pa.Table.from_arrays([some.column(l).combine_chunks().take(pa.array(i)), ids.take(pa.array(j)), pa.array(cos)], schema=kind))
        return pa.concat_tables(found) if found else kind.empty_table()

    kinds = [df.schema[name].dataType.simpleString() for df, name in ((left, l), (right, r))]
    return ls.groupBy(*keys).cogroup(rs.groupBy(*keys)).applyInArrow(compare, f"{l} {kinds[0]}, {r} {kinds[1]}, cos double")
