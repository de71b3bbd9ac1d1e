"""Numpy helpers over the UTF-8 bytes of an Arrow batch of texts.

A batch is cut into chunks of whole documents, so that temporary arrays stay
small whatever the batch holds; a document longer than a chunk is a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


BYTE_HASH = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


powers = _Powers()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, its bytes, offsets from 0) of each chunk."""
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def prefix_hash(byte_hash: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any span by ``span_hash``."""
    out = np.zeros(len(byte_hash) + 1, np.uint64)
    np.cumsum(byte_hash * powers(len(byte_hash) + 1)[0][: len(byte_hash)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), equal for equal bytes."""
    down = powers(len(prefix))[1]
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_HASH, most: int = CHUNK_BYTES) -> np.ndarray:
    """``span_hash`` of ascending spans, formed from about ``most`` bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    for some, first, last in stretches(starts, ends, most):
        out[some] = span_hash(prefix_hash(table[data[first:last]]), starts[some] - first, ends[some] - first)
    return out


def stretches(starts: np.ndarray, ends: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[slice, int, int]]:
    """Neighbouring spans that lie in about ``most`` bytes, with the first and the end byte of each stretch."""
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + most, side="right")))
        yield slice(at, stop), int(starts[at]), int(ends[stop - 1])
        at = stop


def is_long(offsets: np.ndarray) -> bool:
    """Whether a chunk is one document that is better taken in pieces."""
    return len(offsets) == 2 and offsets[1] > 2 * CHUNK_BYTES


def by_pieces(encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``encode`` of one long document, piece by piece, so that temporary arrays stay small.

    Pieces begin with a blank or line feed that follows a visible ASCII character,
    where a pre-token begins whatever is around it; a text without any is one piece.
    """
    fits = np.flatnonzero(((data[1:] == 32) | (data[1:] == 10)) & (data[:-1] > 32) & (data[:-1] < 127)) + 1
    cuts = [0]
    while (k := int(np.searchsorted(fits, cuts[-1] + CHUNK_BYTES))) < len(fits):
        cuts.append(int(fits[k]))
    ids = np.concatenate([encode(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)])
    return ids, np.array([0, len(ids)])


def doc_of(offsets: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The document of each byte position."""
    return np.searchsorted(offsets, position, side="right") - 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
