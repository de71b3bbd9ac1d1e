"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash answers whole pre-tokens that are in the
vocabulary, for a chunk of documents at once; the distinct others are merged with
a heap over linked bytes and remembered. The tables hold one entry for each
vocabulary entry, so what Spark broadcasts is bounded by the vocabulary.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from corpusloom.functions.text import named
from corpusloom.llm import _bytes as B
from corpusloom.llm._shared import bounded_batches
from corpusloom.llm.pretokens import pretoken_starts

#: Distinct merged pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def hash_all(pieces: list[bytes]) -> np.ndarray:
    """The span hash of each byte string."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    prefix = B.prefix_hash(B.BYTE_HASH[data])
    return B.span_hash(prefix, np.append(0, ends[:-1]), ends)


@dataclass
class PerfectHash:
    """n distinct 64-bit keys on the slots 0..n-1: hash, then displace by bucket.

    Buckets are placed from the largest on; ``shift`` holds the displacement with
    which all keys of a bucket found free slots, or -1 - slot for a single key.
    """

    keys: np.ndarray
    shift: np.ndarray

    @staticmethod
    def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
        return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def _slot(keys: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
        return (B.mix64(keys + shift.astype(np.uint64) * B._ODD) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        buckets = max(1, n // 4)
        order = np.argsort(cls._bucket(keys, buckets), kind="stable")
        ordered = cls._bucket(keys, buckets)[order]
        starts, ends = np.searchsorted(ordered, np.arange(buckets)), np.searchsorted(ordered, np.arange(buckets), side="right")
        shift, taken, placed = np.zeros(buckets, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
        tries = np.arange(64)
        for b in np.argsort(starts - ends, kind="stable"):
            mine = order[starts[b] : ends[b]]
            if len(mine) < 2:
                break
            base = 0
            while True:
                slots = cls._slot(keys[mine][None, :], (tries + base)[:, None], n)
                slots.sort(axis=1)
                fits = np.flatnonzero(~taken[slots].any(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1))
                if len(fits):
                    shift[b] = base + fits[0]
                    break
                base += len(tries)
            at = cls._slot(keys[mine], np.full(len(mine), shift[b]), n)
            taken[at], placed[at] = True, mine
        free = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(ends - starts == 1):
            slot = next(free)
            shift[b], placed[slot] = -1 - slot, order[starts[b]]
        return cls(keys[placed], shift)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key that is there; any slot for the others."""
        shift = self.shift[self._bucket(keys, len(self.shift))]
        return np.where(shift < 0, -1 - shift, self._slot(keys, np.maximum(shift, 0), len(self.keys)))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of least rank, the leftmost first, until no pair has a rank."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, until = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != until:
            continue  # one of the two parts has changed meanwhile
        end[i], end[middle] = until, 0
        if until < n:
            before[until] = i
            if (rank := ranks.get(piece[i : end[until]])) is not None:
                heapq.heappush(heap, (rank, i, end[until]))
        if (j := before[i]) >= 0 and (rank := ranks.get(piece[j:until])) is not None:
            heapq.heappush(heap, (rank, j, until))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@dataclass
class Vocabulary:
    """Tables of one vocabulary; built on the driver, sent once to each executor."""

    ranks: dict[bytes, int]
    table: PerfectHash
    ids: np.ndarray
    blob: np.ndarray
    blob_at: np.ndarray
    known: dict[int, list[int]] = field(default_factory=dict)

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int]) -> Vocabulary:
        tokens = sorted(ranks, key=ranks.get)
        keys = hash_all(tokens)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two tokens of this vocabulary have one hash")
        table = PerfectHash.build(keys)
        at = {int(k): ranks[t] for k, t in zip(keys, tokens, strict=True)}
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        return cls(ranks, table, np.array([at[int(k)] for k in table.keys], np.int64), np.frombuffer(b"".join(by_id), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in by_id]))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a chunk and the offsets of each document in them."""
        return B.by_pieces(self._encode, data) if B.is_long(offsets) else self._encode(data, offsets)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = pretoken_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        keys = B.span_hash(B.prefix_hash(B.BYTE_HASH[data]), starts, ends)
        slot = self.table.slots(keys)
        hit = self.table.keys[slot] == keys
        counts = np.ones(len(starts), np.int64)
        _, first, inverse = np.unique(keys[~hit], return_index=True, return_inverse=True)
        missed = np.flatnonzero(~hit)
        merged = [self._merged(int(keys[i]), data[starts[i] : ends[i]]) for i in missed[first]]
        sizes = np.array([len(m) for m in merged], np.int64)
        counts[missed] = sizes[inverse]
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        out[at[hit]] = self.ids[slot[hit]]
        if len(missed):
            flat = np.array([i for m in merged for i in m], np.int64)
            begin = np.cumsum(sizes) - sizes
            out[B.ranges(at[missed], counts[missed])] = flat[B.ranges(begin[inverse], sizes[inverse])]
        token_at = np.append(at, len(out))[np.searchsorted(starts, offsets)]
        return out, token_at

    def _merged(self, key: int, piece: np.ndarray) -> list[int]:
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[key] = merge(piece.tobytes(), self.ranks)
        return found

    def decode(self, ids: np.ndarray, token_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents and the offsets of each document in them."""
        size = self.blob_at[ids + 1] - self.blob_at[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        return self.blob[B.ranges(self.blob_at[ids], size)], ends[token_at]


def encode_documents(docs: DataFrame, ranks_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text_col`` in the array column ``out`` in its place.

    A null text counts as empty and has no ids. Other columns pass unchanged; a
    column named ``out`` is replaced. Repeated rows are encoded each; an empty
    table stays empty. No shuffle.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.from_ranks(load_ranks(ranks_path)))
    rest = [c for c in docs.columns if c not in (text_col, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            data, offsets = B.text_buffers(batch.column(len(rest)))
            for a, b, part, off in B.chunks(data, offsets):
                ids, at = vocabulary.encode(part, off)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(rest))), lists], names=[*rest, out])

    source = docs.select(*map(named, rest), F.col(named(text_col)).cast("string"))
    schema = StructType([*source.schema[: len(rest)], StructField(out, ArrayType(IntegerType()))])
    return source.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for in the binary column ``out``.

    The bytes are those that were encoded, so valid UTF-8 comes back as it was. A
    null array gives empty bytes; an id outside the vocabulary is an error.
    """
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.from_ranks(load_ranks(ranks_path)))
    rest = [c for c in encoded.columns if c != out]
    where = rest.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            column = batch.column(where)
            lists = np.where(column.is_null(), 0, column.value_lengths().fill_null(0)).astype(np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.concatenate(([0], np.cumsum(lists)))
            for a, b, part, off in B.chunks(ids, at, B.CHUNK_BYTES // 4):
                data, ends = vocabulary.decode(part, off)
                binary = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(rest))), binary], names=[*rest, out])

    source = encoded.select(*map(named, rest))
    return source.mapInArrow(run, StructType([*source.schema, StructField(out, BinaryType())]))


def encoding_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of an encode and decode round trip."""
    encoded = encode_documents(docs.select("doc_id", "text"), ranks_path)
    decoded = decode_documents(encoded, ranks_path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
