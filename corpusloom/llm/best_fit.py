"""Best-fit packing of whole documents, certified by lower bounds.

Documents longer than a sequence are cut into full ones and a first, shorter piece;
full pieces are sequences of their own. The others are dealt into partitions, and a
task packs each by best-fit decreasing. Dual feasible functions bound the number of
sequences that a partition needs; one that uses no more is certified. Partitions
with a gap give the documents of their unfilled sequences away, certified ones those
of their emptiest sequence; what is given away is dealt anew and packed again, round
after round, while the whole table has a gap and a round closes some of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _bytes as B
from corpusloom.llm._shared import bounded_batches, materialize
from corpusloom.llm.library_tokens import LibraryTokens, with_end

LONGEST = 2048
#: About so many pieces make a partition; a larger table has more partitions.
PARTITION_PIECES = 1 << 13
#: Rounds of exchange at most. More only save sequences; every piece has one after the first.
ROUNDS = 6
#: The dual feasible functions of Fekete and Schepers for k up to this.
FUNCTIONS = 40

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, own long"
_PLACED = _PIECES + ", bin long, offset long, given boolean"


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Full pieces, and before them one for what is left."""
    return [n % longest] * (n % longest > 0) + [longest] * (n // longest)


def lower_bound(counts: np.ndarray) -> int:
    """The most that any dual feasible function asks for; counts[x] pieces have length x, len(counts) - 1 is full.

    A function u of k rounds each length to a k-th, without letting pieces that fit
    together sum to more than one; before it, pieces of at most e count as nothing and
    those that leave at most e as full. Both for every k and e, in integers.
    """
    full = len(counts) - 1
    x, counts = np.arange(full + 1, dtype=np.int64), counts.astype(np.int64)
    e = np.arange((full + 1) // 2)
    large = counts[::-1].cumsum()[::-1][full - e]  # pieces that leave at most e
    best = 0
    for k in range(FUNCTIONS):
        unit = max(k, 1) * full  # what a full sequence counts
        value = x if k == 0 else np.where((k + 1) * x % full == 0, x * k, (k + 1) * x // full * full)
        sums = np.concatenate(([0], (counts * value).cumsum()))
        total = sums[full - e] - sums[e + 1] + large * unit
        best = max(best, int((-(-total // unit)).max(initial=0)))
    return best


def best_fit(lengths: list[int], longest: int = LONGEST) -> list[int]:
    """The bin of each length, given in descending order: always the fullest bin that still has room."""
    free: list[list[int]] = [[] for _ in range(longest + 1)]
    open_, bins, out = 0, 0, []
    for length in lengths:
        fits = open_ >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                open_ ^= 1 << room
        else:
            room, at, bins = longest, bins, bins + 1
        out.append(at)
        room -= length
        if room:
            free[room].append(at)
            open_ |= 1 << room
    return out


def _pieces(path: str, end_id: int, longest: int, with_ids: bool, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, met = LibraryTokens.of(path), TaskContext.get().partitionId() << 36
        encode = tokens.encode_added if added else tokens.encode
        for batch in batches:
            data, offsets = B.text_buffers(batch.column(1))
            for a, b, text, off in B.chunks(data, offsets):
                ids, at = with_end(*encode(text, off), end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                rows: list[tuple] = []
                blobs: list[bytes] = []
                for doc_id, first, last in zip(batch.column(0).slice(a, b - a).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    start = 0
                    for piece, length in enumerate(piece_lengths(last - first, longest)):
                        part = raw[4 * (first + start) : 4 * (first + start + length)]
                        rows.append((doc_id, piece, start, length, zlib.crc32(part), met))
                        if with_ids:
                            blobs.append(part.tobytes())
                        start += length
                        met += 1
                kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4)
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "own"]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(blobs, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return run


def _packing(longest: int):
    def run(table: pa.Table) -> pa.Table:
        """A partition packed; ``given`` marks the pieces that it gives away."""
        table = table.drop_columns(["part"]).sort_by([("length", "descending"), ("own", "ascending")])
        length = table["length"].to_numpy()
        at = np.array(best_fit(length.tolist(), longest), np.int64)
        filled = np.bincount(at, length).astype(np.int64)
        order = np.argsort(at, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.zeros(len(filled), np.int64)
        first[at[order[::-1]]] = before[::-1]
        offset = np.empty(len(at), np.int64)
        offset[order] = before - first[at[order]]
        certified = len(filled) == lower_bound(np.bincount(length, minlength=longest + 1))
        if certified:
            gives = np.zeros(len(filled), bool)
            gives[filled.argmin()] = filled.min() < longest
        else:
            gives = filled < longest
        # A sequence is named by the piece that opened it.
        named = table["own"].to_numpy()[order[np.searchsorted(at[order], np.arange(len(filled)))]]
        for name, column in (("bin", pa.array(named[at])), ("offset", pa.array(offset)), ("given", pa.array(gives[at]))):
            table = table.append_column(name, column)
        return table

    return run


def _packed(pieces: DataFrame, n: int, longest: int, ids: str) -> DataFrame:
    """``pieces`` dealt into partitions and packed, written."""
    parts = max(1, -(-n // PARTITION_PIECES))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("own"), F.lit(parts)))
    return materialize(dealt.groupBy("part").applyInArrow(_packing(longest), _PLACED + ids), "packed")


def _sequences(placed: DataFrame) -> tuple[int, int, int]:
    """Sequences, sequences given away and pieces given away."""
    opens = F.col("offset") == 0
    return placed.agg(F.count_if(opens), F.count_if(opens & F.col("given")), F.count_if("given")).first()


def pack_best_fit(docs: DataFrame, tokenizer_path: str, end_id: int = 0, longest: int = LONGEST, with_ids: bool = False, added: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked, ids.

    ids holds 32-bit little-endian token ids of the tokenizers library, ``end_id``
    after each document; a null or empty text is the end id alone. Only a document of
    more than ``longest`` ids is cut. A sequence holds at most ``longest`` ids, placed
    without gaps from 0; sequence_id is a number of its own, not a count. Rows of one
    doc_id are packed each; a null doc_id stays null; other columns are dropped; an
    empty table has no pieces. With ``added``, a text's added tokens get their ids.

    Texts are read once and never move; what is dealt are pieces, about
    PARTITION_PIECES of them to a task, whatever their lengths. What comes to the
    driver are counts, and how many pieces have each length.
    """
    bounded_batches(docs.sparkSession)
    ids = ", ids binary" * with_ids
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(source.mapInArrow(_pieces(tokenizer_path, end_id, longest, with_ids, added), _PIECES + ids), "pieces")
    kept = [c for c in pieces.columns if c != "own"]
    result = lambda df: df.select(*kept, F.col("bin").alias("sequence_id"), "offset")
    done = result(pieces.where(F.col("length") == longest).withColumns({"bin": F.col("own"), "offset": F.lit(0).cast("long")}))

    counts = np.zeros(longest + 1, np.int64)
    for row in pieces.where(F.col("length") < longest).groupBy("length").count().collect():
        counts[row.length] = row["count"]
    least, open_, pool = lower_bound(counts), 0, int(counts.sum())
    placed = _packed(pieces.where(F.col("length") < longest), pool, longest, ids)
    used, given, moving = _sequences(placed)
    for _ in range(ROUNDS):
        if open_ + used == least or not moving or moving == pool and pool <= PARTITION_PIECES:
            break
        again = _packed(placed.where("given").select(*pieces.columns), moving, longest, ids)
        now, next_given, next_moving = _sequences(again)
        if now >= given:
            break
        done = done.unionByName(result(placed.where("not given")))
        open_, placed, pool = open_ + used - given, again, moving
        used, given, moving = now, next_given, next_moving
    return done.unionByName(result(placed))
