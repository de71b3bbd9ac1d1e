"""Packing token ids into sequences by powers of two.

A document of n ids is cut into pieces of the longest allowed length and, for
what is left, of the powers of two in it, the longest first. Every piece is a
sequence of its own, so none crosses documents and none needs padding; equal
lengths make a bucket, and sequence numbers run through bucket after bucket, so a
batch of one bucket is a dense matrix.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import _bytes as B
from corpusloom.llm._shared import bounded_batches, frugal, materialize
from corpusloom.llm.library_tokens import ENCODED_BYTES, LibraryTokens, with_end

LONGEST = 2048

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The lengths of the pieces of n ids; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pieces(path: str, end_id: int, longest: int, with_ids: bool, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = LibraryTokens.of(path), TaskContext.get().partitionId()
        encode = tokens.encode_added if added else tokens.encode
        met: dict[int, int] = {}
        for batch in batches:
            data, offsets = B.text_buffers(batch.column(1))
            for a, b, text, off in B.chunks(data, offsets, ENCODED_BYTES):
                ids, at = with_end(*encode(text, off), end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                rows: list[tuple] = []
                blobs: list[bytes] = []
                for doc_id, first, last in zip(batch.column(0).slice(a, b - a).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    start = 0
                    for length in piece_lengths(last - first, longest):
                        piece = raw[4 * (first + start) : 4 * (first + start + length)]
                        place = met.get(length, 0)
                        met[length] = place + 1
                        rows.append((doc_id, start, length, zlib.crc32(piece), last - first, place))
                        if with_ids:
                            blobs.append(piece.tobytes())
                        start += length
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array([part] * len(rows), pa.int32()), pa.array(columns[5], pa.int64())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(blobs, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, longest: int = LONGEST, with_ids: bool = True, added: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids.

    ids holds 32-bit little-endian token ids of the tokenizers library, ``end_id``
    after each document; a null or empty text is the end id alone. offset is 0
    throughout. With ``added``, a text's added tokens get their ids, as the library
    gives them by default; without, they are plain text. sequence_id numbers all pieces from 0, longest bucket first, without
    gaps. Rows of one doc_id are packed each; a null doc_id stays null; other
    columns are dropped; an empty table has no pieces.

    Texts are read once and never move: a task numbers its pieces of each length,
    and only its counts, a few rows for each task, are summed over all tasks.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(source.mapInArrow(frugal(_pieces(tokenizer_path, end_id, longest, with_ids, added)), _SCHEMA + ", ids binary" * with_ids), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    inside = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    buckets = counts.groupBy("length").agg(F.sum("n").alias("total"))
    buckets = buckets.withColumn("base", F.sum("total").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("total"))
    first = inside.join(buckets, "length").select("length", "part", (F.col("base") + F.col("before")).alias("first"))
    numbered = pieces.join(first, ["length", "part"])
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    return numbered.select(*kept, *["ids"] * with_ids)
