"""Token counts without token ids.

A text's tokens are those of its pre-tokens, one after the other.  One pass
over the texts writes each document's pre-token frequencies; every distinct
pre-token's pieces are counted once; frequencies meet these counts by a join on
the pre-token and are summed for each document.

Pre-tokens that hold more than one part in FREQUENT of all frequencies, of
which there can't be more than FREQUENT, meet their counts by broadcast, so
that the shuffled join has no hot key; the most frequent ones only, where
these would take more than FREQUENT_BYTES.
"""

from __future__ import annotations

import functools
import json
import os
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
SEGMENT = 1 << 20
MEMO = 200_000  # most pre-tokens of one text that are gathered before they are written
ROWS = 65_536
FREQUENT, FREQUENT_BYTES = 1_000_000, 64 << 20
OTHER = "\0"  # marks pre-tokens that the library has normalised and cut

#: Characters on whose class, case and canonical form all Unicode versions and both regular-expression engines agree.
_PLAIN = regex.compile("[\t\n\r\x20-\x7e¡-¬®-įı-ňŊ-ž–—‘-„…]*")
_SPACE = regex.compile(r"\s")


class PieceCounter:
    """Pre-tokens of a text, and pieces of a pre-token, by one tokenizer file of the library ``tokenizers``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        normal = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if normal != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"]:
            raise ValueError(f"{path}: only lower-casing tokenizers that keep the matches of one pattern are supported")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def frequencies(self, text: str) -> Iterator[tuple[int, Counter]]:
        """Special tokens and pre-token frequencies of a whole text, in runs that add up."""
        parts = self.special.split(text) if self.special and "<" in text else [text]
        special, found = len(parts) - 1, Counter()
        for part in parts:
            for at, end in _cuts(part):
                piece = part if end - at == len(part) else part[at:end]
                if _PLAIN.fullmatch(piece):
                    found.update(self.pattern.findall(piece.lower()))
                else:
                    normal = self.tokenizer.normalizer.normalize_str(piece)
                    found.update(OTHER + x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))
                if len(found) > MEMO:
                    yield special, found
                    special, found = 0, Counter()
        yield special, found

    def pieces(self, tokens: list[str]) -> list[int]:
        """The number of pieces of each pre-token."""
        plain = [x for x in tokens if not x.startswith(OTHER)]
        known = dict(zip(plain, map(len, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)), strict=True))
        return [known[x] if x in known else len(self.tokenizer.model.tokenize(x[1:])) for x in tokens]

    def count(self, text: str) -> int:
        """Tokens of a whole text as the library's encode(text, add_special_tokens=False) gives them."""
        total = 0
        for special, found in self.frequencies(text):
            total += special + sum(map(int.__mul__, self.pieces(list(found)), found.values()))
        return total


@functools.lru_cache(4)
def loaded(path: str) -> PieceCounter:
    """One tokenizer a worker process and file."""
    return PieceCounter(path)


def _cuts(text: str) -> Iterator[tuple[int, int]]:
    """Parts of about SEGMENT characters that end before white space, which no pre-token holds."""
    at = 0
    while len(text) - at > SEGMENT:
        space = _SPACE.search(text, at + SEGMENT)
        if not space:
            break
        yield at, space.start()
        at = space.start()
    yield at, len(text)


def _share(counts: DataFrame, most: int = FREQUENT, most_bytes: int = FREQUENT_BYTES) -> int:
    """In how many documents a pre-token stands that meets its count by broadcast.

    At most ``most`` pre-tokens can have so many of all entries, and those
    that do have ``most_bytes`` together; the longer they are, the more
    frequent they have to be.
    """
    classes = counts.groupBy((F.length(F.bin("documents")) - 1).alias("c")).agg(F.sum("documents").alias("n"), F.sum(F.octet_length("token") + 16).alias("b")).collect()  # a row for each power of two
    share, size = sum(x.n for x in classes) // most + 1, 0
    for x in sorted(classes, key=lambda x: -x.c):
        size += x.b
        if size > most_bytes:
            return max(share, 2 << x.c)
    return share


def token_counts(documents: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, in any order.

    ``tokenizer`` is a file that every executor can open at that path.  A null
    text counts as empty: 0 bytes, 0 tokens.  Rows that repeat are counted and
    returned each; a null doc_id is kept; texts of any length are read in
    parts; an empty table gives no rows; columns other than doc_id and text are
    ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "tokens")

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, task = loaded(tokenizer), TaskContext.get()
        row = (task.partitionId() if task else 0) << 40  # a number for each document, settled by being written
        columns: tuple[list, ...] = ([], [], [], [], [])

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            for x in columns:
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "n_bytes", "token", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc_id, text, size = doc_id.as_py(), text.as_py() or "", len(text.as_buffer() or b"") if text.is_valid else 0
                row += 1
                for special, found in counter.frequencies(text):
                    # a document's first column entries stand beside a null token, with its special tokens
                    n = len(found)
                    for x, more in zip(columns, ([row] * (n + 1), [doc_id] + [None] * n, [size] + [None] * n, [None, *found], [special, *found.values()]), strict=True):
                        x += more
                    if len(columns[0]) > ROWS:
                        yield flush()
        yield flush()

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(tokenizer)
        for batch in batches:
            pieces = counter.pieces(batch.column("token").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("documents"), pa.array(pieces, pa.int64())], names=["token", "documents", "pieces"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch.save(map_arrow(rows, frequencies, "row long, doc_id long, n_bytes long, token string, n long"), compression="zstd")
    distinct = found.where("token is not null").groupBy("token").agg(F.count("*").alias("documents"))
    counts = scratch.save(map_arrow(distinct, counted, "token string, documents long, pieces long"))
    share = _share(counts)
    frequent, rare = F.broadcast(counts.where(F.col("documents") >= share).select("token", "pieces")), counts.where(F.col("documents") < share).select("token", "pieces")
    pairs = found.where("token is not null").select("row", "token", "n")
    parts = [
        found.where("token is null").select("row", "doc_id", "n_bytes", F.col("n").alias("tokens")),
        pairs.join(frequent, "token").select("row", (F.col("n") * F.col("pieces")).alias("tokens")),
        pairs.join(frequent, "token", "left_anti").join(rare, "token").select("row", (F.col("n") * F.col("pieces")).alias("tokens")),
    ]
    summed = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("row")
    out = summed.agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
