"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
text.  A text that resembles the good dictionary's text compresses to fewer
bytes with it than with the other one; the difference of the two compressed
sizes over their sum is turned into a probability by logistic calibration,
given the ratio without a dictionary, on labelled rows that neither dictionary
has seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, table

SAMPLE_ROWS, SAMPLE_BYTES = 1500, 4 << 20
LEAST_TEXTS = 16  # of a class, however long they are
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
PIECE = 1 << 10
THRESHOLD = 0.7


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the calibration of what they tell."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    @property
    def learnt(self) -> bool:
        """Whether there was a label to learn from; without one all scores are 0.5."""
        return any(self.weights)

    def scorer(self):
        """A function from text to probability, with its own compressors."""
        measure = _measure(self.good, self.bad)

        def score(text: str) -> float:
            z = float(np.dot(self.weights, measure(text.encode())))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if data:
        data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def _measure(good: bytes, bad: bytes):
    """Features of a text: 1, the normalised compressed-size difference, and the plain ratio with its square.

    The ratio without a dictionary tells text that repeats itself, on which
    both dictionaries do equally well, so the calibration depends on it.
    """
    with_good, with_bad, plain = map(_compressor, (good, bad, b""))

    def measure(data: bytes) -> tuple[float, ...]:
        pieces = [data[at : at + PIECE] for at in range(0, len(data), PIECE)]  # so that a dictionary counts everywhere
        g, b = (sum(len(tool.compress(x)) for x in pieces) for tool in (with_good, with_bad))
        ratio = len(plain.compress(data)) / (len(data) + 16.0)
        return (1.0, 20.0 * (b - g) / max(1, b + g), ratio, ratio * ratio)

    return measure


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself."""
    pieces = [x[at : at + PIECE] for x in texts for at in range(0, len(x), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[:DICTIONARY_BYTES]


def _calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method, the classes weighted as they come."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train_quality(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """A model from documents (doc_id, text) and labels (doc_id, quality); rows with a null in any of these are skipped.

    The sample is bounded: of each class the ``rows`` labels of the smallest
    hash of doc_id are chosen, whose texts are taken in that order until
    ``most_bytes``, but LEAST_TEXTS of them in any case; of several texts under
    one id, the one of the smallest hash.  Only the choice, at most 2 * ``rows``
    ids, meets the texts, by their sizes first.
    One half makes the dictionaries, the other half calibrates.  Without rows
    of both classes the score is near 1 or 0 if there is one class, 0.5 if
    there is none.
    """
    named = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    chosen = None
    for quality in (0, 1):
        part = named.where(F.col("quality") == quality).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    # sizes first, one text an id; only texts that are taken are brought together
    sized = texts.join(F.broadcast(chosen), "doc_id").groupBy("h", "doc_id", "quality").agg(F.min(F.struct("digest", F.octet_length("text").alias("size"))).alias("t"))
    before = Window.partitionBy("quality").orderBy("h", "doc_id")
    placed = sized.select("h", "doc_id", "quality", "t.*", F.row_number().over(before).alias("place"), F.coalesce(F.sum("t.size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    taken = placed.where((F.col("before") <= most_bytes) | (F.col("place") <= LEAST_TEXTS)).select("h", "doc_id", "quality", "digest")
    sample = texts.join(F.broadcast(taken), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest", "quality"]).orderBy("h", "doc_id", "quality")
    found: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sample.toLocalIterator():
        found[row["quality"]].append(row["text"].encode())
    halves = {q: (texts[::2], texts[1::2]) for q, texts in found.items()}
    if not halves[0][1] or not halves[1][1]:
        sign = bool(found[1]) - bool(found[0])
        return QualityModel(b"", b"", (6.0 * sign, 0.0, 0.0, 0.0))
    good, bad = _dictionary(halves[1][0]), _dictionary(halves[0][0])
    measure = _measure(good, bad)
    x = np.array([measure(t) for q in (0, 1) for t in halves[q][1]])
    y = np.array([q for q in (0, 1) for _ in halves[q][1]], dtype=float)
    return QualityModel(good, bad, tuple(_calibrate(x, y)))


def score_quality(documents: DataFrame, model: QualityModel, column: str = "quality_score") -> DataFrame:
    """All columns of ``documents`` but ``column``, the score, which is added (replaced, if there).

    Reads whole texts.  A null text is scored as the empty one.  Rows that
    repeat are scored each; an empty table gives no rows.
    """
    kept = [c for c in documents.columns if c != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema) + f", `{column}` double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = pa.array([score(x.as_py() or "") for x in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), scores], names=[*kept, column])

    return map_arrow(documents.select(*kept), run, schema)


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fold_model(documents: DataFrame, labels: DataFrame) -> QualityModel:
    """A model learnt from labelled rows whose crc32(doc_id) mod 4 is not 2."""
    return train_quality(documents, labels.where(~_held_out()))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fold_model(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("quality_score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", _held_out().alias("held_out"), F.col("quality_score").alias("score"), predicted.alias("predicted"))
