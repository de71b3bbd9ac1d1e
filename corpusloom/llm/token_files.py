"""Token ids in files: frequency ranks in bytes, lengths in separate control bytes.

The commonest id gets rank 0, so most ranks fit one byte. Four ranks share one
control byte with two bits each for their length of 1 to 4 bytes; the data bytes
follow each other without padding. A reader looks the four lengths of a control
byte up in a table of 256 rows and gathers all values at once.

A file is Parquet, one row for each block of whole documents: part and block
number, document ids, ids of each document, control bytes, data bytes. Parts and
blocks are in ascending order of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import _bytes as B
from corpusloom.llm._shared import bounded_batches, frugal, materialize
from corpusloom.llm.library_tokens import ENCODED_BYTES, LibraryTokens, with_end

BLOCK_SCHEMA = "part int, block int, doc_ids array<long>, sizes array<int>, controls binary, data binary"
_LENGTHS = np.array([[(c >> shift & 3) + 1 for shift in (0, 2, 4, 6)] for c in range(256)], np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative ranks below 2**32."""
    values = ranks.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    codes = codes.reshape(-1, 4)
    controls = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4)[None, :] < size[:, None]
    return controls.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(controls: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks again."""
    size = _LENGTHS[np.frombuffer(controls, np.uint8)].ravel()[:count]
    begin = np.cumsum(size) - size
    source = np.frombuffer(data, np.uint8)
    out = source[begin].astype(np.int64)
    for k in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > k)
        out[longer] |= source[begin[longer] + k].astype(np.int64) << (8 * k)
    return out


def _token_blocks(docs: DataFrame, path: str, end_id: int, added: bool) -> DataFrame:
    """Blocks of 16-bit or 32-bit ids in document order, and how often each id occurs in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, block = LibraryTokens.of(path), TaskContext.get().partitionId(), 0
        encode = tokens.encode_added if added else tokens.encode
        wide = "<u2" if tokens.library.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            data, offsets = B.text_buffers(batch.column(1))
            for a, b, text, off in B.chunks(data, offsets, ENCODED_BYTES):
                ids, at = with_end(*encode(text, off), end_id)
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "doc_ids": pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(pa.int64())), "sizes": pa.array([np.diff(at)], pa.list_(pa.int32())), "ids": pa.array([ids.astype(wide).tobytes()], pa.binary())}
                )
                block += 1

    return docs.mapInArrow(frugal(run), "part int, block int, doc_ids array<long>, sizes array<int>, ids binary")


def _ids_of(row_ids: bytes, count: int) -> np.ndarray:
    return np.frombuffer(row_ids, "<u2" if len(row_ids) == 2 * count else "<u4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: one row for each id it met."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for sizes, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            now = np.bincount(_ids_of(ids.as_py(), sum(sizes)))
            if len(now) > len(total):
                total, now = now, total
            total[: len(now)] += now
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(met, pa.int64()), "n": pa.array(total[met], pa.int64())})


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, added: bool = False) -> DataFrame:
    """Write the ids of all texts under ``path`` and return the rank table (id, rank, n).

    Texts are encoded by the tokenizers library without special tokens, ``end_id``
    after each; with ``added``, added tokens inside a text get their ids, as the
    library gives them by default. A null text is an empty one and has the end id only. Documents are
    ordered by doc_id, null first, then by text, whatever other columns there are;
    repeated rows are written each. The rank table holds one row for each id that
    occurs, so it is bounded by the vocabulary; ties go to the smaller id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = materialize(_token_blocks(ordered, tokenizer_path, end_id, added), "tokens")
    counts = blocks.select("sizes", "ids").mapInArrow(frugal(_count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = sorted(((-r.n, r.id) for r in counts.collect()))
    by_rank = np.array([i for _, i in counts], np.int64)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack(shared.value[_ids_of(ids.as_py(), sum(sizes))]) for sizes, ids in zip(batch.column(3).to_pylist(), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *(pa.array([p[i] for p in packed], pa.binary()) for i in range(2))], names=["part", "block", "doc_ids", "sizes", "controls", "data"])

    blocks.mapInArrow(frugal(run), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")
    ranks = spark.createDataFrame([(int(i), r, int(-n)) for r, (n, i) in enumerate(counts)], "id long, rank long, n long")
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    return ranks


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, 32-bit little-endian) of every document in the files.

    start counts the ids of all documents before it. Offsets inside a part come
    from a window over its blocks; of a part only its total is needed elsewhere.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    by_rank = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.int64)
    shared = spark.sparkContext.broadcast(by_rank)
    sizes = blocks.select("part", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x).alias("n"))
    in_part = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    totals = sizes.groupBy("part").agg(F.sum("n").alias("total"))
    parts = totals.withColumn("base", F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total"))
    starts = in_part.join(parts, "part").select("part", "block", (F.col("base") + F.col("before")).alias("first"))
    placed = blocks.join(starts, ["part", "block"]).select("first", "doc_ids", "sizes", "controls", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = np.array(row["sizes"], np.int64)
                ends = np.cumsum(size)
                ids = shared.value[unpack(row["controls"], row["data"], int(size.sum()))].astype("<u4")
                cuts = pa.py_buffer(np.concatenate(([0], ends * 4)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - size), pa.array(size), pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, cuts, pa.py_buffer(ids)])],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(frugal(run), "doc_id long, start long, n_tokens long, ids binary")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

