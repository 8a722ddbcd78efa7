"""Periodic runs of words: maximal stretches that repeat with some period.

The words of a text are numbered.  For an order of these numbers and for its
inverse, the Lyndon array is computed from left to right; to compare two
suffixes, their common extension is taken from the extension matched furthest
so far wherever it covers them, so that words are compared anew only beyond
what has been matched and the whole is linear.  The longest Lyndon word at a
place, followed by itself, gives the period and the right end of a run; the
same on the reversed text gives its left end.  No suffix structure or
fingerprint of words is made.

A word of a run stands at most one period behind its last occurrence.  Only
stretches where this holds long enough are looked at, which is told for all
texts of a batch at once and loses no run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

MIN_LENGTH, MIN_REPEATS = 24, 3
CHUNK = 4 << 20
FAR = np.iinfo(np.int64).max
RUNS = "array<struct<start: long, length: long, period: long>>"


def lyndon_array(s: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next smaller suffix, which ends the longest Lyndon word there, and their common extension.

    The suffixes compared are those linked by next or previous smaller
    suffixes; these links don't cross.  ``s[a:a+q-b] == s[b:q]`` is the
    extension that was matched furthest: a pair inside ``[b, q)`` has been
    compared before, ``b - a`` places to the left.
    """
    n = len(s)
    following, common = [n] * n, [0] * n
    before, shared = [-1] * n, [0] * n
    a = b = q = 0
    for r in range(1, n):
        at = r - 1
        while at >= 0:
            if r >= q:
                known, further = 0, True
            elif at >= b:
                known = common[at - b + a] if following[at - b + a] == r - b + a else shared[r - b + a]
                further = r + known >= q
                known = q - r if further else known
            else:  # r is b, and ``at`` the previous smaller suffix of a
                known = shared[a]
                further = known == q - r
                if known > q - r:
                    known = q - r
                    a = at
            if further:
                q = r + known
                i = at + known
                while q < n and s[i] == s[q]:
                    i += 1
                    q += 1
                a, b, known = at, r, q - r
            if r + known < n and s[at + known] < s[r + known]:
                before[r], shared[r] = at, known
                break
            following[at], common[at] = r, known
            at = before[at]
    return following, common


def _repeated(s: list[int], repeats: int) -> set[tuple[int, int, int]]:
    """(period, place, end): the first Lyndon root of each run, where the run goes on for more than ``repeats - 2`` periods after it."""
    out = set()
    for order in (s, [-x for x in s]):
        following, common = lyndon_array(order)
        for at, (r, m) in enumerate(zip(following, common, strict=True)):
            p = r - at
            if m > (repeats - 2) * p and not (at >= p and following[at - p] == at and common[at - p] >= p):
                out.add((p, at, r + m))
    return out


def runs_of(s: list[int], length: int = MIN_LENGTH, repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``length`` items and ``repeats`` periods (three or more), in that order.

    Two runs of one period share less than it, so that a period and the block
    of that size in which a run starts name the run.
    """
    n = len(s)
    ends = _repeated(s, repeats)
    if not ends:
        return []
    starts = {(p, (n - end) // p): n - end for p, _, end in _repeated(s[::-1], repeats)}
    out = set()
    for p, at, end in ends:
        for block in (at // p, at // p - 1):
            start = starts.get((p, block), at + 1)
            if start <= at < start + p and end - start >= max(length, repeats * p):
                out.add((start, end - start, p))
    return sorted(out, key=lambda run: (run[0], run[2]))


def stretches(back: np.ndarray, length: int = MIN_LENGTH, repeats: int = MIN_REPEATS) -> list[tuple[int, int]]:
    """Disjoint stretches, in order, that hold every run whole.  ``back`` is the distance of each item to its last occurrence.

    Items of a run after its first period are at most one period from their
    last occurrence.  For periods up to each power of two, stretches of such
    items are kept if they are long enough, with the period in front.
    """
    n, found, top = len(back), [], 1
    while top * (repeats - 1) // 2 < n:
        least = max(length - length // repeats, (repeats - 1) * (top // 2 + 1))
        near = np.zeros(n + 2, dtype=np.int8)
        near[1:-1] = back <= top
        turns = np.flatnonzero(np.diff(near))
        begin, end = turns[::2], turns[1::2]
        long = end - begin >= least
        found.append(np.stack([np.maximum(begin[long] - top - 1, 0), np.minimum(end[long] + 1, n)], axis=1))
        top *= 2
    spans = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
    out: list[tuple[int, int]] = []
    for begin, end in spans[np.lexsort((spans[:, 1], spans[:, 0]))].tolist():
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and where each text's begin (and the last one's end)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    given = pc.greater(pc.binary_length(flat), 0)
    sums = np.concatenate([[0], np.cumsum(given.to_numpy(zero_copy_only=False))])
    offsets = parts.offsets.to_numpy()
    return flat.filter(given), sums[offsets - offsets[0]]


def _distances(numbers: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The distance of each word to its last occurrence in the same text."""
    order = np.lexsort((numbers, owner))
    same = (numbers[order[1:]] == numbers[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    back = np.full(len(numbers), FAR)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    return back


def found_runs(texts: pa.Array, length: int, repeats: int) -> tuple[list[list[tuple[int, int, int]]], pa.Array]:
    """The runs of each text, and its words without those that repeat, joined by one space."""
    words, begins = words_of(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(begins))
    numbers = words.dictionary_encode().indices.to_numpy() if len(words) else np.zeros(0, dtype=np.int32)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    kept = np.ones(len(words), dtype=bool)
    for begin, end in stretches(_distances(numbers, owner), length, repeats):
        # a stretch may reach into the text before it, of which it then holds the end alone
        edges = [begin, *begins[(begins > begin) & (begins < end)].tolist(), end]
        for lo, hi in zip(edges, edges[1:], strict=False):
            for start, size, period in runs_of(numbers[lo:hi].tolist(), length, repeats):
                kept[lo + start + period : lo + start + size] = False
                runs[owner[lo]].append((int(lo + start - begins[owner[lo]]), size, period))
    sums = np.concatenate([[0], np.cumsum(kept)])
    left = pa.LargeListArray.from_arrays(pa.array(sums[begins]), words.filter(pa.array(kept)))
    return runs, pc.binary_join(left, " ")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about CHUNK bytes of text; a longer text is a part of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("__text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _finding(length: int, repeats: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                runs, collapsed = found_runs(part.column("__text"), length, repeats)
                named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in each] for each in runs]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(named, kind), collapsed.cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(documents: DataFrame, text: str | Column = "text", length: int = MIN_LENGTH, repeats: int = MIN_REPEATS) -> DataFrame:
    """One row per row of ``documents``: doc_id, runs (start, length and period, by start, then period) and collapsed.

    Words are maximal runs of characters other than ASCII white space,
    numbered from 0.  A run is a stretch with smallest period q of at least
    ``length`` words and ``repeats`` (three or more) times q that no
    neighbouring word extends.  ``collapsed`` are the words, joined by one
    space, without those that stand in any run after its first q words.  Null
    and empty texts have no runs and an empty ``collapsed``; a null doc_id
    stays; rows that repeat are judged each, alike; an empty table gives no
    rows.  Other columns are not read.
    """
    if repeats < 3:
        raise ValueError("runs of fewer than three periods are not told by their roots")
    given = F.col(text) if isinstance(text, str) else text
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), given.cast("string").alias("__text"))
    return map_arrow(rows, _finding(length, repeats), f"doc_id long, runs {RUNS}, collapsed string")


def with_repeats(doc_id: Column, text: Column) -> Column:
    """The text; for every tenth hash of an id, its words from some place on repeat from there with some period."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    # each step is bound once by a lambda's variable
    sized = F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), lambda s: F.struct(s["w"].alias("w"), s["g"].alias("g"), F.size(s["w"]).cast("long").alias("n")))
    from_ = F.transform(F.filter(sized, lambda s: s["n"] > 0), lambda s: F.struct(s["w"].alias("w"), s["g"].alias("g"), s["n"].alias("n"), (s["g"] % s["n"]).alias("a")))
    period = F.transform(from_, lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), s["a"].alias("a"), (F.lit(1) + F.floor((s["n"] - s["a"]) / (F.lit(3) + s["g"] % 8))).alias("p")))

    def written(s: Column) -> Column:
        place = lambda i: F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"])
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: s["w"][place(i).cast("int")]), " ")

    return F.when(h % 10 == 0, F.coalesce(F.try_element_at(F.transform(period, written), F.lit(1)), F.lit(""))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs, with_repeats(F.col("doc_id"), F.col("text")))
    more = lambda r, s: r["length"] * s["period"] > s["length"] * r["period"]
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda s, r: F.when(s.isNull() | more(r, s), r).otherwise(s))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
