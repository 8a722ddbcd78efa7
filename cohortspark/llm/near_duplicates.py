"""Near-duplicate documents by a signature-coordinate inverted join.

1. One pass over the texts gives each document its shingle count, a digest of
   its shingle set and a MinHash signature.  Documents with equal sets form a
   class; only class representatives go on, so copies cost nothing more.
2. Representatives are posted under coordinate-value pairs: a coordinate is a
   run of ``WIDTH`` MinHash values.  Of ``COORDINATES``, two sets that are to
   agree in ``LEAST`` must meet in the first COORDINATES - LEAST + 1, so only
   that prefix is posted.  Posting lists of one document are skipped.
3. Within a list, signatures are compared position by position and a pair is
   retained at a number of equal positions six deviations below the expected;
   pairs that other pairs of the list already connect are skipped, so a list
   gives at most one edge per document.  Long lists are dealt out as pairs of
   blocks.
4. Shingle sets of the documents that have an edge are made once and written.
   Every retained edge is confirmed on full sets.
5. An edge that fails may have hidden a link which the skipping took for known.
   So, where confirmed links leave a component of the edges in several parts,
   the members outside its largest part are compared with all of its members,
   block by block, again skipping what is connected.  Confirmed links of both
   steps give the result's components.

For a pair just at a threshold of 0.8 the chance to be missed by step 2 is
below 2e-7 and by step 3 about 1e-8 (less at 0.85); every link is confirmed on
full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import Scratch, map_arrow, table, whole_groups
from .components import connected_components

COORDINATES, WIDTH, LEAST = 32, 4, 3
POSITIONS = 256
LIST_BLOCK, SET_BLOCK = 1024, 200_000
SIMILARITY = (80, 100)

_SIGNED = "doc_id long, digest long, n_shingles long, d1 long, d2 long, posts array<long>, signature binary"


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prefix = COORDINATES - LEAST + 1
    for batch in batches:
        for at, data, offsets in shingles.chunks(batch.column("text")):
            hashes, starts = shingles.shingle_sets(data, offsets)
            d1, d2 = shingles.set_digest(hashes, starts)
            keys, signature = shingles.signature(hashes, starts, COORDINATES, WIDTH, POSITIONS)
            rows = len(starts) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(at, rows),
                    batch.column("digest").slice(at, rows),
                    pa.array(np.diff(starts), pa.int64()),
                    pa.array(d1.view(np.int64)),
                    pa.array(d2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * prefix, pa.int32()), pa.array(keys[:, :prefix].reshape(-1).view(np.int64))),
                    pa.array([x.tobytes() for x in signature], pa.binary()),
                ],
                names=["doc_id", "digest", "n_shingles", "d1", "d2", "posts", "signature"],
            )


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in shingles.chunks(batch.column("text")):
            hashes, starts = shingles.shingle_sets(data, offsets)
            rows = len(starts) - 1
            found = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, rows), found.cast(pa.list_(pa.int64()))], names=["node", "shingles"])


class _Forest:
    """Labels of one group's rows; join() is told which rows connect."""

    def __init__(self, label: np.ndarray):
        self.label = label.copy()

    def join(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]


def matches_for(similarity: tuple[int, int]) -> int:
    """Equal positions from which a pair is retained: six standard deviations below what the threshold gives."""
    p = similarity[0] / similarity[1]
    return max(1, math.floor(POSITIONS * p - 6 * math.sqrt(POSITIONS * p * (1 - p))))


def _open_pairs(forest: _Forest, i: int, side: np.ndarray, crossing: bool, signature: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Later rows that are not yet connected with row i and match its signature, and their matches."""
    ahead = np.flatnonzero(forest.label[i + 1 :] != forest.label[i]) + i + 1
    if crossing:
        ahead = ahead[side[ahead] != side[i]]
    matches = np.concatenate([(signature[part] == signature[i]).sum(axis=1) for part in np.array_split(ahead, len(ahead) // 4096 + 1)])
    good = matches >= least
    return ahead[good], matches[good]


def _read_group(rows: pa.Table, a: int, b: int) -> tuple[np.ndarray, np.ndarray, bool]:
    part = rows.slice(a, b - a)
    column = part.column("signature").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    signature = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(b - a, POSITIONS)
    side = part.column("side").to_numpy()
    return signature, side, part.column("lo")[0].as_py() != part.column("hi")[0].as_py()


def _list_edges(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """At most one edge a document for each list: pairs retained by their signatures."""
    for rows, edges in whole_groups(batches, ["post", "lo", "hi"]):
        node = rows.column("node").to_numpy()
        us, vs = [], []
        size = np.diff(edges)
        for a, b in zip(edges[:-1][size > 1], edges[1:][size > 1], strict=True):
            signature, side, crossing = _read_group(rows, a, b)
            forest = _Forest(np.arange(b - a))
            for i in range(b - a - 1):
                for j in _open_pairs(forest, i, side, crossing, signature, least)[0]:
                    if forest.label[i] != forest.label[j]:
                        forest.join(i, j)
                        us.append(node[a + i])
                        vs.append(node[a + j])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _confirmed(batches: Iterable[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links confirmed on full shingle sets between the two sides of each block pair, at most one for each of its documents."""
    least, (numerator, denominator) = matches_for(similarity), similarity
    for rows, edges in whole_groups(batches, ["cluster", "lo", "hi"]):
        node, known, sets = rows.column("node").to_numpy(), rows.column("label").to_numpy(), rows.column("shingles")
        us, vs = [], []
        size = np.diff(edges)
        for a, b in zip(edges[:-1][size > 1], edges[1:][size > 1], strict=True):
            signature, side, _ = _read_group(rows, a, b)
            full = [x.values.to_numpy().view(np.uint64) for x in sets.slice(a, b - a)]
            n = np.array([len(x) for x in full])
            forest = _Forest(np.unique(known[a:b], return_inverse=True)[1])
            for i in range(b - a - 1):
                js, matches = _open_pairs(forest, i, side, True, signature, least)
                near = denominator * np.minimum(n[js], n[i]) >= numerator * np.maximum(n[js], n[i])
                js, matches = js[near], matches[near]
                for j in js[np.argsort(-matches, kind="stable")]:
                    if forest.label[i] != forest.label[j]:
                        both = len(np.intersect1d(full[i], full[j], assume_unique=True))
                        if denominator * both >= numerator * (n[i] + n[j] - both):
                            forest.join(i, j)
                            us.append(node[a + i])
                            vs.append(node[a + j])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _dealt(rows: DataFrame, blocks: str) -> DataFrame:
    """Rows of a group over all pairs (lo, hi) of its blocks in which they stand; side tells the two blocks apart."""
    own = F.pmod(F.xxhash64("node"), F.col(blocks))
    return (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
        .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        .withColumn("side", (F.col("own") != F.col("lo")).cast("int"))
        .drop("own", "other", blocks)
    )


def _links(edges: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The edges whose full sets are similar enough."""
    numerator, denominator = similarity
    of = lambda side: sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("shingles").alias(f"set_{side}"))
    sizes = lambda side: sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"))
    near = edges.join(sizes("u"), "u").join(sizes("v"), "v").where(denominator * F.least("n_u", "n_v") >= numerator * F.greatest("n_u", "n_v")).select("u", "v")
    pairs = near.join(of("u"), "u").join(of("v"), "v").withColumn("both", F.size(F.array_intersect("set_u", "set_v")))
    return pairs.where(denominator * F.col("both") >= numerator * (F.col("n_u") + F.col("n_v") - F.col("both"))).select("u", "v")


def _by_root(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): the components that edges connect, ``roots`` being those known so far; edges within one are left out."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    joined = edges.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return joined.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")).where("u <> v").distinct()


def _hidden_links(apart: DataFrame, roots: DataFrame, sets: DataFrame, classes: DataFrame, similarity: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Links between components of confirmed links (``roots``) that failed edges (``apart``, by components) bring together."""
    clusters = scratch.save(connected_components(apart, scratch).select(F.col("node").alias("label"), F.col("root").alias("cluster")))
    labels = sets.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label"))
    parts = scratch.save(labels.join(clusters, "label").select("cluster", "node", "label"))
    weights = parts.join(sets.select("node", "n"), "node").groupBy("cluster", "label").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
    open_ = weights.groupBy("cluster").agg(F.max_by("label", F.struct("members", "label")).alias("largest"), F.max(F.struct("members", "label", "n"))["n"].alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / SET_BLOCK)).cast("long")
    open_ = scratch.save(open_.select("cluster", "largest", blocks(F.col("n") - F.col("most")).alias("outer"), blocks(F.col("n")).alias("inner")))
    members = parts.join(open_, "cluster").join(classes.select("node", "signature"), "node").join(sets.select("node", "shingles"), "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["cluster", "node", "label", "signature", "shingles"]
    outside = members.where("label <> largest").withColumns({"lo": own("outer"), "side": F.lit(0)}).select(*columns, "lo", every("inner").alias("hi"), "side")
    inside = members.withColumns({"hi": own("inner"), "side": F.lit(1)}).select(*columns, every("outer").alias("lo"), "hi", "side")
    dealt = outside.unionByName(inside).repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "side", "node")
    return map_arrow(dealt, lambda x: _confirmed(x, similarity), "u long, v long")


def near_duplicates(documents: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least ``similarity``, a fraction from 0.75.

    Reads ``doc_id`` and ``text``; other columns are ignored.  Returns doc_id,
    n_shingles, component_id (the smallest doc_id reachable), kept (it is the
    row's own), digest (xxhash64 of the text) and chosen: true for the
    documents of one doc_id and digest in each component, and for those that
    take no part.

    Null and empty texts, and texts of white space, have no shingles and stand
    alone.  Every row is judged by its own text, so rows that repeat a doc_id
    with other texts may be in other components; rows that repeat id and text
    share one judgement.  A row with a null doc_id takes no part: its
    component_id is null and it is kept.  An empty table gives no rows.
    """
    if similarity[0] < 0.75 * similarity[1]:
        raise ValueError("the posted coordinates are chosen for similarities from 0.75")
    least = matches_for(similarity)
    spark = documents.sparkSession
    scratch = Scratch(spark, "near")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    signed = scratch.save(map_arrow(docs, _signatures, _SIGNED))
    # a class is one set; its node number is settled by being written
    classes = scratch.save(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("d1", "d2")
        .agg(F.min(F.struct("doc_id", "digest")).alias("rep"), F.max("n_shingles").alias("n_shingles"), F.min_by(F.struct("posts", "signature"), F.struct("doc_id", "digest")).alias("s"))
        .select("d1", "d2", F.monotonically_increasing_id().alias("node"), "rep.doc_id", "rep.digest", "n_shingles", "s.posts", "s.signature")
    )
    posts = classes.select("node", F.explode("posts").alias("post"))
    lists = posts.groupBy("post").agg(F.count("*").alias("size")).where("size > 1")
    lists = lists.select("post", F.ceil(F.col("size") / LIST_BLOCK).cast("long").alias("blocks"))
    # (node, post) of lists worth reading first, signatures only then
    shared = posts.join(lists, "post")
    dealt = _dealt(shared.join(classes.select("node", "signature"), "node"), "blocks")
    # in order of nodes, so that lists of the same documents give the same edges
    ordered = dealt.repartition("post", "lo", "hi").sortWithinPartitions("post", "lo", "hi", "node")
    edges = scratch.save(map_arrow(ordered, lambda x: _list_edges(x, least), "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    texts = docs.join(ends.join(classes.select("node", "doc_id", "digest"), "node"), ["doc_id", "digest"]).select("node", "text")
    sets = scratch.save(map_arrow(texts, _sets, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles")).withColumn("n", F.size("shingles")))
    links = scratch.save(_links(edges, sets, similarity))
    roots = scratch.save(connected_components(links, scratch))
    apart = scratch.save(_by_root(edges.join(links, ["u", "v"], "left_anti"), roots))
    if not apart.isEmpty():
        hidden = scratch.save(_by_root(_hidden_links(apart, roots, sets, classes, similarity, scratch), roots))
        if not hidden.isEmpty():
            joined = scratch.save(connected_components(hidden, scratch).select(F.col("node").alias("before"), F.col("root").alias("after")))
            every = classes.select("node").join(roots, "node", "left").withColumn("before", F.coalesce("root", "node"))
            roots = scratch.save(every.join(joined, "before", "left").select("node", F.coalesce("after", "before").alias("root")))
    named = classes.select("d1", "d2", "node", "doc_id", "digest").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    named = scratch.save(named.select("d1", "d2", "root").join(first, "root").select("d1", "d2", "first"))
    scratch.keep_only(signed, named)
    out = signed.select("doc_id", "digest", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    chosen = alone | (F.struct("doc_id", "digest") == F.col("first"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "digest", chosen.alias("chosen"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), (85, 100)).drop("digest", "chosen")
