"""Vectorised word shingles and MinHash coordinates over Arrow string buffers.

Words are the maximal runs of bytes other than ASCII white space, after A-Z
has been lower-cased.  A shingle is five consecutive words; a text of one to
four words is one shingle, a text without words has none.  All arithmetic is
done on whole chunks of texts, so the cost per byte is a few numpy passes, and
a chunk holds at most ``CHUNK_BYTES`` of text (or one text, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SHINGLE_WORDS = 5

_RNG = np.random.Generator(np.random.PCG64(20_231))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULT = _RNG.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(x: int) -> int:
    """The inverse of an odd number modulo 2**64."""
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % (1 << 64)
    return y


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


class _Tables:
    """Powers of the rolling base, grown on demand and kept by the worker."""

    size = 0
    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def need(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= 2 * CHUNK_BYTES:
            if cls.size < n:
                cls.size = 2 * CHUNK_BYTES + 1
                cls.up, cls.down = (_powers(b, cls.size) for b in (int(_STEP), _inverse(int(_STEP))))
            return cls.up, cls.down
        return tuple(_powers(b, n + 1) for b in (int(_STEP), _inverse(int(_STEP))))


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, bytes, row offsets) for runs of rows of a string column; null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within a row: (hashes, starts), starts has rows + 1 entries."""
    rows = len(offsets) - 1
    # one separator after each row keeps words of neighbouring rows apart
    padded = np.full(len(data) + rows, 0x20, dtype=np.uint8)
    keep = np.ones(len(padded), dtype=bool)
    keep[offsets[1:] + np.arange(rows)] = False
    padded[keep] = _LOWER[data]
    space = _SPACE[padded]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _Tables.need(len(padded) + 1)
    total = np.zeros(len(padded) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[padded] * up[: len(padded)], out=total[1:])
    word = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _MULT[0])
    row_of = np.searchsorted(offsets[1:] + np.arange(rows), begin, side="right")
    n_words = np.bincount(row_of, minlength=rows)
    first = np.concatenate(([0], np.cumsum(n_words)))
    if len(word) >= SHINGLE_WORDS:
        span = len(word) - SHINGLE_WORDS + 1
        full = np.zeros(span, dtype=np.uint64)
        for i in range(SHINGLE_WORDS):
            full += word[i : i + span] * _MULT[i]
        inside = row_of[:span] == row_of[SHINGLE_WORDS - 1 :]
        hashes, owner = mix(full[inside]), row_of[:span][inside]
    else:
        hashes, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    few = np.flatnonzero((n_words > 0) & (n_words < SHINGLE_WORDS))
    if len(few):
        short = np.zeros(len(few), dtype=np.uint64)
        for i in range(SHINGLE_WORDS - 1):
            has = n_words[few] > i
            short[has] += word[first[few[has]] + i] * _MULT[i]
        short = mix(short + n_words[few].astype(np.uint64))
        hashes, owner = np.concatenate((hashes, short)), np.concatenate((owner, few))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))


def set_digest(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for each row's set; 0, 0 for the empty set."""
    a, b = mix(hashes + np.uint64(0xA5A5)), mix(hashes ^ np.uint64(0x5BD1E995))
    pad = lambda x: np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64)))
    a, b = pad(a), pad(b)
    return a[starts[1:]] - a[starts[:-1]], b[starts[1:]] - b[starts[:-1]]


def signature(hashes: np.ndarray, starts: np.ndarray, count: int, width: int, positions: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash of each row: posting keys (rows x count, uint64) and one byte a position (rows x positions).

    Key k digests positions k * width .. (k + 1) * width - 1 and k itself, so
    equal keys mean equal values of one coordinate.  Empty sets get zeros.
    """
    rows = len(starts) - 1
    keys, bytes_ = np.zeros((rows, count), dtype=np.uint64), np.zeros((rows, positions), dtype=np.uint8)
    some = np.flatnonzero(starts[1:] > starts[:-1])
    if not len(some):
        return keys, bytes_
    factors = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    buffer = np.empty_like(hashes)
    digest = np.zeros(len(some), dtype=np.uint64)
    for p in range(positions):
        np.multiply(hashes, factors[p], out=buffer)
        value = mix(np.minimum.reduceat(buffer, starts[some]))
        bytes_[some, p] = value >> np.uint64(56)
        k, within = divmod(p, width)
        if k < count:
            digest = mix((digest if within else np.full(len(some), np.uint64(k + 1))) * _MULT[1] + value)
            if within == width - 1:
                keys[some, k] = digest
    return keys, bytes_
