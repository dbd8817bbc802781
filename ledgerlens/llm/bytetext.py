"""Texts of an Arrow column as bytes, words and hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
U = np.uint64


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, end row, bytes, offsets (one more than rows).  Null is empty.

    A text longer than the limit is a run of its own, whole.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@lru_cache(1)
def _white() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and where each text's words begin in them."""
    inside = ~_white()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit hashes spread over the whole word (the splitmix64 finaliser)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@lru_cache(64)
def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit value per byte."""
    return mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = U(base), U(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, self.base, U)]))
            self.down = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, self.inverse, U)]))
        return self.up[:n], self.down[:n]


_powers = {0: Powers(0x9E3779B97F4A7C15), 1: Powers(0xD1342543DE82EF95)}


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for every span, equal for equal sequences wherever they stand."""
    up, down = _powers[kind].to(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of every word; long texts are worked through in runs of words, so that memory stays small."""
    found = []
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, "right")))
        low = starts[at]
        found.append(span_hash(byte_values(seed)[data[low : ends[end - 1]]], starts[at:end] - low, ends[at:end] - low, seed & 1))
        at = end
    return np.concatenate(found) if found else np.zeros(0, U)


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` words from each word on lie in one text."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(len(ends)) + size <= ends


def window_hashes(hashes: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
    """Hash of the ``size`` words from each word on, whether or not they lie in one text; the last ``size - 1`` have none."""
    starts = np.arange(max(0, len(hashes) - size + 1))
    return span_hash(hashes, starts, starts + size, kind)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring values."""
    have = 1
    while have * 2 <= width and len(values) > have:
        values, have = np.minimum(values[:-have], values[have:]), have * 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest and len(values) > rest else values[: len(values) - rest]
