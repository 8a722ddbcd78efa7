"""Approximate nearest neighbours by a forest of random-projection trees.

The tops of the trees are grown on the driver from a bounded sample: a node
splits its vectors at the median of their projection on the difference of two
of them.  Below the sampled leaves a tree goes on with fixed random
projections, cut at the projection of the leaf's centre, by as many levels as
the table's size asks for, so that leaves keep their size.  Every vector is
posted under its leaf in each tree, with a code of one byte a component.  A
query walks all trees through one shared priority queue, ordered by the largest
margin by which its path has crossed a split.  How many leaves it takes is
measured on the sample: as many as find a share TARGET of true neighbours there.

Probes meet postings by (tree, leaf); codes give a leaf's best few candidates,
and no more than can beat the sample's own neighbours of the query.  The best
of all leaves are reranked by the exact cosine of the original vectors, which
are fetched once for that.

Equal vectors are one entry with its few smallest ids, so a vector that a
third of the rows hold costs one posting a tree; large leaves are dealt out in
parts.  Rows travel, never pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, table, whole_groups

TREES, LEAVES, SAMPLE = 8, 256, 16_384
LEAF_ROWS = 2048
TARGET, TRIALS, LEAST_PROBES = 0.97, 200, 64
KEEP, SLACK = 4, 0.02  # candidates a neighbour that are reranked; what a code may be wrong by
PART = 65_536


@dataclass(frozen=True)
class Forest:
    """Per tree: split vectors, cuts, and children (node numbers; -1 - leaf for a leaf); below, ``levels`` fixed projections with each leaf's cuts."""

    planes: list[np.ndarray]
    cuts: list[np.ndarray]
    children: list[np.ndarray]
    leaves: list[int]
    centres: list[np.ndarray]
    levels: int = 0
    below: tuple = ()

    def deepened(self, levels: int, seed: int = 5) -> Forest:
        """The forest with each leaf split ``levels`` times more."""
        rng = np.random.default_rng(seed)
        below = []
        for centres in self.centres:
            direction = rng.standard_normal((levels, centres.shape[1])).astype(np.float32)
            direction /= np.linalg.norm(direction, axis=1)[:, None] if levels else 1
            below.append((direction, centres @ direction.T))
        return replace(self, levels=levels, below=tuple(below))

    def post(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of unit vectors in each tree: rows x trees."""
        out = np.zeros((len(x), len(self.planes)), dtype=np.int64)
        for t, (planes, cuts, children) in enumerate(zip(self.planes, self.cuts, self.children, strict=True)):
            at = np.zeros(len(x), dtype=np.int64) if len(planes) else np.full(len(x), -1)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                right = np.einsum("ij,ij->i", x[inner], planes[node]) > cuts[node]
                at[inner] = children[node, right.astype(int)]
            leaf = -1 - at
            if self.levels:
                direction, cut = self.below[t]
                for bit in (x @ direction.T > cut[leaf]).T:
                    leaf = leaf * 2 + bit
            out[:, t] = leaf
        return out

    def probe(self, x: np.ndarray, count: int) -> list[tuple[int, int]]:
        """The first ``count`` (tree, leaf) that a query meets in the shared queue."""
        margins = [planes @ x - cuts if len(planes) else None for planes, cuts in zip(self.planes, self.cuts, strict=True)]
        lower = [(direction @ x, cut) for direction, cut in self.below] if self.levels else []
        # crossed, tree, node or leaf, levels below the leaf, bits taken there
        queue = [(0.0, t, 0 if len(p) else -1, 0, 0) for t, p in enumerate(self.planes)]
        found: list[tuple[int, int]] = []
        while queue and len(found) < count:
            crossed, t, node, level, bits = heapq.heappop(queue)
            while node >= 0:
                m = margins[t][node]
                near = int(m > 0)
                heapq.heappush(queue, (max(crossed, abs(m)), t, int(self.children[t][node, 1 - near]), 0, 0))
                node = int(self.children[t][node, near])
            while level < self.levels:
                m = lower[t][0][level] - lower[t][1][-1 - node, level]
                near = int(m > 0)
                heapq.heappush(queue, (max(crossed, abs(m)), t, node, level + 1, bits * 2 + 1 - near))
                bits, level = bits * 2 + near, level + 1
            found.append((t, (-1 - node << self.levels) + bits))
        return found

    def needed(self, sample: np.ndarray, k: int, target: float = TARGET, trials: int = TRIALS) -> float:
        """The share of all leaves after which a share ``target`` of the true ``k`` nearest in the sample have been met."""
        total = sum(self.leaves)
        if len(sample) <= k + 1:
            return 1.0
        leaves, pick = self.post(sample), np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int)
        ranks = []
        for i in pick:
            likeness = sample @ sample[i]
            likeness[i] = -2
            near = np.argpartition(-likeness, k)[:k]
            order = {leaf: rank for rank, leaf in enumerate(self.probe(sample[i], total), 1)}
            ranks += [min(order[t, int(leaf)] for t, leaf in enumerate(leaves[j])) for j in near]
        return float(np.quantile(ranks, target)) / total


def grow(sample: np.ndarray, trees: int = TREES, leaves: int = LEAVES, seed: int = 3) -> Forest:
    """The tops of a forest over unit vectors; a tree has up to ``leaves`` leaves of at least eight sampled vectors or so."""
    rng = np.random.default_rng(seed)
    size = max(8, -(-len(sample) // leaves))
    planes, cuts, children, counts, middles = [], [], [], [], []
    for _ in range(trees):
        p: list[np.ndarray] = []
        c: list[float] = []
        kids: list[list[int]] = []
        leaf, centres = 0, []
        todo = [(np.arange(len(sample)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            split = None
            if len(rows) > size:
                for _ in range(4):
                    a, b = rng.choice(rows, 2, replace=False)
                    w = sample[a] - sample[b]
                    norm = np.linalg.norm(w)
                    if norm > 1e-9:
                        m = sample[rows] @ (w / norm)
                        cut = float(np.median(m))
                        right = m > cut
                        if right.any() and not right.all():
                            split = (w / norm, cut, right)
                            break
            if split is None:
                if parent >= 0:
                    kids[parent][side] = -1 - leaf
                centres.append(sample[rows].mean(axis=0))
                leaf += 1
                continue
            node = len(p)
            p.append(split[0])
            c.append(split[1])
            kids.append([0, 0])
            if parent >= 0:
                kids[parent][side] = node
            todo += [(rows[split[2]], node, 1), (rows[~split[2]], node, 0)]
        planes.append(np.array(p, dtype=np.float32).reshape(len(p), sample.shape[1]))
        cuts.append(np.array(c, dtype=np.float32))
        children.append(np.array(kids, dtype=np.int64).reshape(len(kids), 2))
        counts.append(leaf)
        middles.append(np.array(centres, dtype=np.float32).reshape(leaf, sample.shape[1]))
    return Forest(planes, cuts, children, counts, middles)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # so that no square leaves the range
    return x / np.linalg.norm(x, axis=1)[:, None]


def _code(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components as whole numbers from -127 to 127, and the size of a step for each row."""
    step = np.abs(unit).max(axis=1) / 127
    return np.rint(unit / step[:, None]).astype(np.int8), step.astype(np.float32)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, of the vectors as they are; powers of two are taken out first, which changes no digit."""
    a, b = (x * np.exp2(-np.frexp(np.abs(x).max(axis=1))[1].astype(float))[:, None] for x in (a, b))
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def usable(vectors: DataFrame, single: bool = False) -> DataFrame:
    """(vec_id, v), v in ``single`` precision or double: rows whose vector is there, not zero, and has neither null nor non-finite components."""
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``queries``, itself left out.

    Both tables have vec_id and embedding.  Nearness is the cosine of the
    original vectors in double precision; ties go to the smaller vec_id.
    Vectors that are null, zero, of another length than the most frequent one,
    or hold null or non-finite components take no part on either side.  Rows
    that repeat a vec_id with the same vector count once.  Fewer candidates
    than ``k`` are all returned; empty tables give no rows.  ``share`` of all
    leaves is probed; by default it is measured on the sample.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    single = all(x.schema["embedding"].dataType.simpleString() == "array<float>" for x in (vectors, queries))
    good, asked = usable(vectors, single), usable(queries, single)
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = sizes[0]["n"] if sizes else 0
    good, asked = good.where(F.size("v") == length), asked.where(F.size("v") == length)
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    few = good.distinct().withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
    entries = scratch.save(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "ids", "v").withColumn("entry", F.monotonically_increasing_id()))
    n_entries = entries.count()
    rows = entries.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(SAMPLE).select("v").collect()
    sample = _unit(np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), length)).astype(np.float32) if rows else np.zeros((0, 1), np.float32)
    forest = grow(sample) if rows else Forest([], [], [], [], [])
    share = forest.needed(sample, k) if share is None and rows else share or 0.0
    tops = sum(forest.leaves) / max(1, len(forest.leaves))
    forest = forest.deepened(max(0, math.ceil(math.log2(max(1, n_entries / LEAF_ROWS / max(1, tops))))))
    probes_each = max(LEAST_PROBES, math.ceil(share * sum(forest.leaves) * 2**forest.levels))
    best_few = KEEP * (k + 1)

    def posted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column("v")))
            leaves, (code, step) = forest.post(unit.astype(np.float32)), _code(unit)
            n, trees = leaves.shape
            each = pa.array(np.repeat(np.arange(n), trees))
            yield pa.RecordBatch.from_arrays(
                [batch.column("entry").take(each), pa.array([x.tobytes() for x in code]).take(each), pa.array(step).take(each), pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(leaves.reshape(-1))],
                names=["id", "code", "step", "tree", "leaf"],
            )

    def probing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column("v")))
            code, step = _code(unit)
            single = unit.astype(np.float32)
            for i in range(batch.num_rows):
                found = forest.probe(single[i], probes_each)
                n = len(found)
                # the query itself may be in the sample, so k + 1 others need k + 2
                least = float(np.partition(sample @ single[i], -(k + 2))[-(k + 2)]) - SLACK if len(sample) >= k + 2 else -2.0
                values = (batch.column("id")[i].as_py(), code[i].tobytes(), float(step[i]), least)
                types = (pa.int64(), pa.binary(), pa.float32(), pa.float32())
                yield pa.RecordBatch.from_arrays([*(pa.array([x], t).take(pa.array([0] * n, pa.int32())) for x, t in zip(values, types, strict=True)), pa.array([t for t, _ in found], pa.int32()), pa.array([leaf for _, leaf in found], pa.int64())], names=["id", "code", "step", "least", "tree", "leaf"])

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_groups(batches, ["tree", "leaf", "part"]):
            ids, is_query = rows.column("id").to_numpy(), rows.column("is_query").to_numpy(zero_copy_only=False)
            step, least = rows.column("step").to_numpy(), rows.column("least").to_numpy()
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype=np.int8).reshape(len(ids), length)
            qs, es, ss = [], [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                asks, has = np.flatnonzero(is_query[a:b]) + a, np.flatnonzero(~is_query[a:b]) + a
                if not len(asks) or not len(has):
                    continue
                held = code[has].astype(np.float32) * step[has][:, None]
                for at in range(0, len(asks), 64):
                    q = asks[at : at + 64]
                    near = (code[q].astype(np.float32) * step[q][:, None]) @ held.T
                    if near.shape[1] > best_few:
                        cut = np.partition(near, -best_few, axis=1)[:, -best_few]
                        where, which = np.nonzero(near >= np.maximum(cut, least[q])[:, None])
                    else:
                        where, which = np.nonzero(near >= least[q][:, None])
                    qs.append(ids[q][where])
                    es.append(ids[has][which])
                    ss.append(near[where, which])
            if qs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qs)), pa.array(np.concatenate(es)), pa.array(np.concatenate(ss), pa.float32())], names=["q", "entry", "near"])

    def reranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("ids"), pa.array(_cosines(_matrix(batch.column("a")), _matrix(batch.column("b"))))], names=["q", "ids", "score"])

    # equal queries are searched once
    hashed = asked.distinct().withColumn("h", F.xxhash64("v"))
    distinct = scratch.save(hashed.select("h", "v").distinct().withColumn("id", F.monotonically_increasing_id()))
    named = scratch.save(hashed.join(distinct, ["h", "v"]).select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")))
    postings = scratch.save(map_arrow(entries.select("entry", "v"), posted, "id long, code binary, step float, tree int, leaf long"))
    parts = scratch.save(postings.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1"))  # seldom any
    n_parts = parts.count()
    parts = F.broadcast(parts) if n_parts <= PART else parts
    columns = ["tree", "leaf", "part", "id", "code", "step", "least", "is_query"]
    of = F.coalesce("parts", F.lit(1))
    held = postings.join(parts, ["tree", "leaf"], "left").withColumns({"part": F.pmod(F.xxhash64("id"), of).cast("int"), "least": F.lit(0.0).cast("float"), "is_query": F.lit(False)})
    probes = map_arrow(distinct.select("id", "v"), probing, "id long, code binary, step float, least float, tree int, leaf long").join(parts, ["tree", "leaf"], "left")
    probes = probes.withColumns({"part": F.explode(F.sequence(F.lit(0), of - 1)), "is_query": F.lit(True)})
    groups = held.select(*columns).unionByName(probes.select(*columns)).repartition("tree", "leaf", "part").sortWithinPartitions("tree", "leaf", "part")
    found = map_arrow(groups, candidates, "q long, entry long, near float").groupBy("q", "entry").agg(F.max("near").alias("near"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "entry"))).where(F.col("r") <= best_few).select("q", "entry")
    pairs = best.join(entries.select("entry", "ids", F.col("v").alias("b")), "entry").join(distinct.select(F.col("id").alias("q"), F.col("v").alias("a")), "q")
    exact = scratch.save(map_arrow(pairs.select("q", "ids", "a", "b"), reranked, "q long, ids array<long>, score double").select("q", "score", F.explode("ids").alias("vec_id")))
    scratch.keep_only(named, exact)
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = named.join(exact, "q").where("vec_id <> query_id")
    return each.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
