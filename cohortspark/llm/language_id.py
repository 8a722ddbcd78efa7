"""Language identification by hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs, a pure function of its
code point.  An n-gram of letters is bound by multiplying its letters' vectors,
each permuted (rotated) by its place in the n-gram; a text is the bundle (sum)
of its n-gram vectors; a language prototype is the bundle of its training
texts, each scaled to the same length.  A text gets the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
SCALE = 1000
ALPHABET, COLUMNS = 160, 12_000
CHUNK = 1 << 20


class _Letters:
    """Per code point: whether it is a letter, and its lower case (its own code point where that is not a single one)."""

    is_letter: np.ndarray | None = None
    lower: np.ndarray

    @classmethod
    def tables(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.is_letter is None:
            codes = [chr(i) for i in range(0x110000)]
            cls.lower = np.array([ord(y) if len(y := x.lower()) == 1 else ord(x) for x in codes], dtype=np.int64)
            cls.is_letter = np.array([x.isalpha() for x in codes])
        return cls.is_letter, cls.lower


@functools.lru_cache(4096)
def _letter(code: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(code)).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)


class Profiles:
    """Text vectors.  Vectors of n-grams over the first ALPHABET letters met are kept, up to COLUMNS of them."""

    def __init__(self) -> None:
        self.index = np.full(0x110000, -1, dtype=np.int64)
        self.letters: list[int] = []
        self.column = np.full(ALPHABET**GRAM, -1, dtype=np.int32)
        self.columns = 0
        self.grams = np.zeros((COLUMNS, DIMENSIONS), dtype=np.float32)

    @staticmethod
    def _gram(codes: Iterable[int]) -> np.ndarray:
        out = np.ones(DIMENSIONS, dtype=np.int8)
        for place, code in enumerate(codes):
            out = out * np.roll(_letter(code), place)
        return out.astype(np.float32)

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The bundles of whole texts, and which texts have a letter.  Runs of other characters count as one break."""
        total = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
        has = np.zeros(len(texts), dtype=bool)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            if size <= 2 * CHUNK:
                self._add(texts[at:end], total[at:end], has[at:end])
            else:  # one very long text, in parts that share no n-gram
                tail = ""
                for i in range(0, size, CHUNK):
                    part = tail + texts[at][i : i + CHUNK]
                    tail = self._add([part], total[at:end], has[at:end], first=not i, last=i + CHUNK >= size)
            at = end
        return total, has

    def _add(self, texts: list[str], total: np.ndarray, has: np.ndarray, first: bool = True, last: bool = True) -> str:
        """Adds the n-grams of the texts; returns the characters that a next part of the last text has to start with."""
        is_letter, lower = _Letters.tables()
        joined = (" " if first else "") + " ".join(texts) + (" " if last else "")
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum([len(x) + 1 for x in texts])
        owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        owner = np.concatenate((owner[:1], owner))[: len(codes)] if first else owner[: len(codes)]
        letter = is_letter[codes]
        has |= np.bincount(owner[letter], minlength=len(texts)) > 0
        codes = np.where(letter, lower[codes], ord(" "))
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:1] = True
        codes, owner = codes[keep], owner[keep]
        tail = "".join(map(chr, codes[1 - GRAM :].tolist()))
        n = len(codes) - GRAM + 1
        if n <= 0:
            return tail
        # an n-gram belongs to the text of its middle, and none has a break there
        middle = GRAM // 2
        inside = codes[middle : middle + n] != ord(" ")
        grams, owner = [codes[i : i + n][inside] for i in range(GRAM)], owner[middle : middle + n][inside]
        for code in np.unique(codes[self.index[codes] < 0]).tolist():
            if len(self.letters) < ALPHABET:
                self.index[code] = len(self.letters)
                self.letters.append(code)
        places = [self.index[x] for x in grams]
        common = np.logical_and.reduce([x >= 0 for x in places])
        keys = sum(x[common] * ALPHABET**i for i, x in enumerate(places))
        for key in np.unique(keys[self.column[keys] < 0]).tolist():
            if self.columns == COLUMNS:
                break
            self.column[key] = self.columns
            self.grams[self.columns] = self._gram(self.letters[key // ALPHABET**i % ALPHABET] for i in range(GRAM))
            self.columns += 1
        columns = self.column[keys]
        common[common] = columns >= 0
        columns = columns[columns >= 0]
        used, columns = np.unique(columns, return_inverse=True) if len(columns) < self.columns else (np.arange(self.columns), columns)
        self._bundle(total, owner[common], columns, self.grams[used] if len(used) < self.columns else self.grams[: self.columns])
        if not common.all():  # n-grams of large alphabets, in blocks of distinct ones
            rare, which = np.unique(np.stack([x[~common] for x in grams], axis=1), axis=0, return_inverse=True)
            which, owner = which.reshape(-1), owner[~common]
            for i in range(0, len(rare), 1024):
                block = (which >= i) & (which < i + 1024)
                self._bundle(total, owner[block], which[block] - i, np.array([self._gram(x) for x in rare[i : i + 1024].tolist()]))
        return tail

    @staticmethod
    def _bundle(total: np.ndarray, owner: np.ndarray, columns: np.ndarray, grams: np.ndarray) -> None:
        for at in range(0, len(total), 128):
            rows = min(128, len(total) - at)
            here = (owner >= at) & (owner < at + rows)
            counts = np.bincount((owner[here] - at) * len(grams) + columns[here], minlength=rows * len(grams))
            total[at : at + rows] += counts.reshape(rows, len(grams)).astype(np.float32) @ grams


def _pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _training(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    profiles, sums = Profiles(), {}
    for batch in batches:
        for part in _pieces(batch):
            vectors, has = profiles.vectors(part.column("text").to_pylist())
            norms = np.linalg.norm(vectors, axis=1)
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            for lang in set(langs[has & (norms > 0)]):
                rows = has & (norms > 0) & (langs == lang)
                # whole numbers, so that the sum doesn't depend on the order of tasks
                scaled = np.rint(vectors[rows] * (SCALE / norms[rows])[:, None]).astype(np.int64).sum(axis=0)
                sums[lang] = sums[lang] + scaled if lang in sums else scaled
            if len(sums) > 256:
                yield _partial(sums)
                sums = {}
    if sums:
        yield _partial(sums)


def _partial(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "bundle"])


def language_prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototypes of the languages in ``labelled`` (text, lang); rows with a null in either are skipped.

    Bundles are summed on the executors; the driver gets one vector a language.
    """
    rows = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    parts = map_arrow(rows, _training, "lang string, bundle array<long>")
    sums = parts.select("lang", F.posexplode("bundle").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for row in sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).orderBy("lang").collect():
        vector = np.array([x["x"] for x in row["v"]], dtype=np.float64)
        out[row["lang"]] = vector / np.linalg.norm(vector)
    return out


def predict_languages(documents: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """All columns of ``documents`` but ``lang_pred`` and ``score``, which are added (replaced, if there).

    ``lang_pred`` is ``und`` and the score 0 where the text is null, has no
    letter, or there is no prototype; otherwise the score is the best cosine,
    cut to 0..1.  Ties go to the smaller language name.  Rows that repeat are
    scored each; an empty table gives no rows.
    """
    names, matrix = list(prototypes), np.array(list(prototypes.values()), dtype=np.float32)
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema) + ", lang_pred string, score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        for batch in (part for whole in batches for part in _pieces(whole)):
            vectors, has = profiles.vectors([x or "" for x in batch.column("text").to_pylist()])
            norms = np.linalg.norm(vectors, axis=1)
            known = has & (norms > 0) & bool(names)
            best, scores = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            if known.any():
                cosines = (vectors[known] / norms[known][:, None]) @ matrix.T
                best[known] = np.array(names, dtype=object)[cosines.argmax(axis=1)]
                scores[known] = np.clip(cosines.max(axis=1), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(best, pa.string()), pa.array(scores)], names=[*kept, "lang_pred", "score"])

    return map_arrow(documents.select(*kept), run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    prototypes = language_prototypes(docs.where(~held_out).select("text", "lang"))
    scored = predict_languages(docs.select("doc_id", "text"), prototypes)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
