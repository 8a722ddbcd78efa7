"""SentencePiece ids by a streaming Viterbi search over a window of bounded length.

Positions of the text are the states of the lattice and pieces its arcs.  A
piece that ends at a position survives if it follows the piece that survives
at its start; for a merge (BPE) vocabulary "follows" is exact: two pieces may
stand side by side if merging their joined characters leaves both as they are.
Then one arc survives at every position, as one segmentation of each prefix
does, and scores need no summing.  Arcs are found by walking a trie from each
position on, so no arc is longer than the longest piece and backpointers stay
open over that window only.  Whenever all surviving paths converge on one
boundary, ids before it are committed: at once where no surviving arc crosses
the position, and by comparing the open paths every FLUSH positions where arcs
keep crossing.  No piece goes over the start of a word or joins letters with
signs, so paths always converge there, and the ids of short words are
remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
MEMO_WORD, MEMO, MEMO_PAIRS = 48, 200_000, 600_000
FLUSH = 256


def _word_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Parts of a text whose ids don't depend on their neighbours: words, and runs of other characters, with the marks before them.

    Two adjacent characters that no piece holds side by side can't be merged,
    so a text may be cut between them.  A character that some piece joins to
    one of the other kind counts as the other kind.
    """
    other: set[str] = set()
    while True:
        plain = lambda c: c.isalnum() and c not in other
        more = {x if plain(x) else y for piece in pieces for x, y in zip(piece, piece[1:]) if MARK not in (x, y) and plain(x) != plain(y)}
        if not more:
            break
        other |= more
    if len(other) > 100:
        return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
    odd = "_" + "".join(re.escape(c) for c in sorted(other))
    return re.compile(rf"{MARK}*(?:[^\W{odd}]+|(?:(?!{MARK})[\W{odd}])+)|{MARK}+")


class Pieces:
    """The vocabulary of a SentencePiece BPE model, with encode and decode of our own.

    A piece is known by its id; a character that is no piece counts as one with
    the id -1 - its code point.
    """

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in ids]
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i in ids if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        hidden = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.hidden = hidden - set(self.bytes)
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in hidden}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.window = max(map(len, self.ids))
        self.unknown = sp.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError(f"{model}: pieces that go on over the start of a word are not supported")
        if sp.normalize("Ａ ½́  x") != f"{MARK}Ａ{MARK}½́{MARK}{MARK}x":
            raise ValueError(f"{model}: only models without a normalisation table are supported")
        # what an id is in a decoded text; None for ids that need more than a lookup (an ASCII byte ends any run of bytes)
        self.shown = [(chr(self.bytes[i]) if self.bytes.get(i, 128) < 128 else None) if i in hidden else self.pieces[i].replace(MARK, " ") for i in ids]
        self.written = [str(i) for i in ids]
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = [self.trie, None]
            for c in piece:
                node = node[0].setdefault(c, [{}, None])
            node[1] = i
        self.word = _word_pattern(list(self.ids))
        self.spines: dict[int, tuple[list, list]] = {}
        self.pairs: dict[int | None, dict[int, bool]] = {}
        self.known_pairs = 0
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _text(self, piece: int) -> str:
        return self.pieces[piece] if piece >= 0 else chr(-1 - piece)

    def _spine(self, piece: int) -> tuple[list, list]:
        """The merges that make a piece of its characters, as (score, first symbol) and (score, last symbol) after each.

        The first entry is the state before any merge.  The lists end early if
        merging does not lead to the piece, which then can't stand in a result.
        """
        found = self.spines.get(piece)
        if found is None:
            symbols = list(self._text(piece))
            first, last = [(None, symbols[0])], [(None, symbols[-1])]
            while len(symbols) > 1:
                scores = [self.score.get(a + b) for a, b in zip(symbols, symbols[1:])]
                known = [x for x in scores if x is not None]
                if not known:
                    first = last = []
                    break
                best = max(known)
                at = scores.index(best)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                first.append((best, symbols[0]))
                last.append((best, symbols[-1]))
            found = self.spines[piece] = (first, last)
        return found

    def _stand(self, a: int | None, b: int) -> bool:
        """Whether merging the characters of ``a`` and ``b``, side by side, leaves both as they are.

        Both go through their own merges, best score first and left before
        right among equals, unless a merge over their border comes first.
        """
        right = self._spine(b)[0]
        if a is None:
            return bool(right)
        left = self._spine(a)[1]
        if not left or not right:
            return False
        score = self.score
        i, j, m, n = 0, 0, len(left) - 1, len(right) - 1
        x, y = left[0][1], right[0][1]
        over = score.get(x + y)
        while True:
            ours = left[i + 1][0] if i < m else None
            theirs = right[j + 1][0] if j < n else None
            if over is not None and (ours is None or over > ours) and (theirs is None or over >= theirs):
                return False
            if ours is not None and (theirs is None or ours >= theirs):
                i += 1
                if left[i][1] != x:
                    x = left[i][1]
                    over = score.get(x + y)
            elif theirs is not None:
                j += 1
                if right[j][1] != y:
                    y = right[j][1]
                    over = score.get(x + y)
            else:
                return True

    def _learn(self, known: dict[int, bool], a: int | None, b: int) -> bool:
        self.known_pairs += 1
        if self.known_pairs > MEMO_PAIRS:
            self.pairs.clear()
            self.known_pairs = 0
        known[b] = answer = self._stand(a, b)
        return answer

    def commits(self, text: str) -> Iterator[list[int]]:
        """Pieces of a text in runs, each yielded as soon as every surviving path holds it."""
        trie, pairs, window = self.trie, self.pairs, self.window
        size = len(text)
        origin = base = reach = 0  # of the tables below; committed up to; the furthest end of an arc
        room = min(size, 4 * FLUSH + window) + 1
        last: list[int | None] = [None] * room  # the piece that survives at origin, origin + 1, ...
        start = [0] * room  # where it starts
        at, look = 0, 2 * FLUSH
        while at < size:
            if at == reach > base:  # no surviving arc goes over this position
                yield self._path(last, start, at, base, origin)
                base = at
            if at >= look:
                if base == origin:
                    base = self._agreed(start, [e for e in range(at, reach + 1) if last[e - origin] is not None], origin)
                    if base > origin:
                        yield self._path(last, start, base, origin, origin)
                shift = base - origin
                last, start = last[shift:] + [None] * shift, start[shift:] + [0] * shift
                origin = base
                look = max(origin + 2 * FLUSH, at + FLUSH)  # later, if arcs have kept crossing
                short = look + window + 1 - origin - len(last)
                if short > 0:
                    last, start = last + [None] * short, start + [0] * short
            a = last[at - origin]
            known = pairs.get(a)
            if known is None:
                known = pairs[a] = {}
            children, end = trie, at - origin
            for c in text[at : at + window]:
                node = children.get(c)
                if node is None:
                    break
                end += 1
                children, piece = node
                if piece is not None and last[end] is None:
                    ok = known.get(piece)
                    if ok is None:
                        ok = self._learn(known, a, piece)
                    if ok:
                        last[end], start[end] = piece, at
                        if origin + end > reach:
                            reach = origin + end
            at += 1
            if last[at - origin] is None:  # some arc ends everywhere, so this one is of a character that is no piece
                last[at - origin], start[at - origin] = -1 - ord(text[at - 1]), at - 1
                reach = max(reach, at)
        if size > base:
            yield self._path(last, start, size, base, origin)

    @staticmethod
    def _path(last: list, start: list[int], end: int, base: int, origin: int) -> list[int]:
        """The pieces from ``base`` to ``end``."""
        out = []
        while end > base:
            out.append(last[end - origin])
            end = start[end - origin]
        out.reverse()
        return out

    @staticmethod
    def _agreed(start: list[int], ends: list[int], base: int) -> int:
        """The last boundary that the paths of all these ends share."""
        agreed: set[int] | None = None
        for end in ends:
            path = {end}
            while end > base:
                end = start[end - base]
                path.add(end)
            agreed = path if agreed is None else agreed & path
        return max(agreed or {base})

    def segments(self, text: str) -> Iterator[str]:
        """Pieces of a text, each yielded as soon as it is committed."""
        return (self._text(i) for run in self.commits(text) for i in run)

    def _found(self, word: str) -> tuple[int, ...]:
        """Ids of a word that the newer half of the memory lacks."""
        ids = self.older.get(word)
        if ids is None:
            out: list[int] = []
            for run in self.commits(word):
                out += run
            if min(out) < 0:
                out = [i for x in out for i in ((x,) if x >= 0 else self._spelt(chr(-1 - x)))]
            ids = tuple(out)
        if len(word) <= MEMO_WORD:
            if len(self.words) >= MEMO:  # the older half goes; frequent words have moved to the newer one
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def _spelt(self, character: str) -> list[int]:
        return [self.byte_id[b] for b in character.encode()] if self.byte_id else [self.unknown]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without begin and end."""
        if not text:
            return []
        words = self.word.findall(MARK + text.replace(" ", MARK))
        found = list(map(self.words.get, words))
        if None in found:
            found = [self.words.get(word) or self._found(word) if ids is None else ids for word, ids in zip(words, found, strict=True)]
        return list(chain.from_iterable(found))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 give U+FFFD each, control ids give nothing."""
        ids = ids if isinstance(ids, list) else list(ids)
        try:
            text = "".join(map(self.shown.__getitem__, ids))
        except TypeError:  # bytes or hidden ids among them
            text = "".join(self._spelling(ids)).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def _spelling(self, ids: Iterable[int]) -> Iterator[str]:
        run = bytearray()
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                yield _utf8(bytes(run))
                run = bytearray()
            if i not in self.hidden:
                yield self.pieces[i]
            elif i == self.unknown:
                yield " ⁇ "
        if run:
            yield _utf8(bytes(run))


def _utf8(run: bytes) -> str:
    return run.decode("utf-8", "replace")


def _small(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encoded(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_chars, ids and n_tokens of every row.

    ``model`` is a file that every executor can open at that path.  A null or
    empty text has no ids; a null doc_id is kept; rows that repeat are returned
    each; an empty table gives no rows; columns other than doc_id and text are
    ignored.  A text of any length is searched with a window of bounded size.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)  # goes with the task, and what it remembers with it
        for batch in _small(batches, 64):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids = [np.array(pieces.encode(x), dtype=np.int32) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())], names=["doc_id", "n_chars", "ids", "n_tokens"]
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_chars long, ids array<int>, n_tokens long")


def decoded(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with ``ids``; null ids give an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)  # goes with the task, and what it remembers with it
        for batch in _small(batches, 64):
            texts = [pieces.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")


def round_trips(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_sha256 (of the ids, comma-joined) and round_trip (decoding gives the text back).

    Edge cases as in ``encoded``; an empty text is its own round trip.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)  # goes with the task, and what it remembers with it
        for batch in _small(batches, 64):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            chars, tokens, digests, same = [], [], [], []
            for text in texts:
                ids = pieces.encode(text)
                chars.append(len(text))
                tokens.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(pieces.written.__getitem__, ids)).encode()).hexdigest())
                same.append(pieces.decode(ids) == text.replace(MARK, " "))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_chars", "n_tokens", "ids_sha256", "round_trip"]
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_chars long, n_tokens long, ids_sha256 string, round_trip boolean")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
