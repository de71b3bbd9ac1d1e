"""Records, vocabularies and token shards in files, and manifests of files."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.tokens import SPECIALS, UNK
from corpusloom.sources.shared import bounded_batches

RECORD = T.StructType([*(T.StructField(n, T.StringType()) for n in ("id", "title", "dynasty", "author", "text")), T.StructField("source_block", T.LongType())])
SHARD_TOKENS = 1 << 24
CHUNK_BYTES = 1 << 20


def read_records_jsonl(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """One object a line; anything else fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_records_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    """Compact JSON lines, keys in column order, nulls kept, other scripts as they are; a folder for each value of ``by``."""
    writer = df.write.option("ignoreNullFields", "false")
    (writer.partitionBy(by) if by else writer).json(path)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """split, shard, tok_start, tokens as split, shard, tok_start, n, unknown and bytes."""
    for batch in batches:
        tokens, sizes = batch.column(3), batch.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = tokens.flatten().to_numpy(zero_copy_only=False).astype("<u2")
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        unknown = np.concatenate(([0], np.cumsum(flat == UNK)))[ends]
        raw = [flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(np.diff(unknown), pa.int64()), pa.array(raw, pa.binary())], names=["split", "shard", "tok_start", "n", "unknown", "raw"])


def _chunks(chunk_bytes: int):
    """Rows in the order of their streams as chunks of a shard; the last one carries the shard's checksum."""
    names = ["split", "shard", "chunk", "records", "n_tokens", "unknown_tokens", "packed", "sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk, sums, held, hashed = None, 0, [0, 0, 0], bytearray(), None

        def emit(raw: bytes, last: bool) -> pa.RecordBatch:
            row = [*at, chunk, *sums, raw, hashed.hexdigest() if last else None]
            kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for split, shard, _, n, unknown, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (split, shard) != at:
                    if at is not None:
                        yield emit(bytes(held), True)
                    at, chunk, sums, held, hashed = (split, shard), 0, [0, 0, 0], bytearray(), sha256()
                hashed.update(raw)
                held += raw
                sums = [sums[0] + 1, sums[1] + n, sums[2] + unknown]
                while len(held) > chunk_bytes:
                    yield emit(bytes(held[:chunk_bytes]), False)
                    held, chunk, sums = held[chunk_bytes:], chunk + 1, [0, 0, 0]
        if at is not None:
            yield emit(bytes(held), True)

    return run


def write_token_shards(encoded: DataFrame, path: str, vocab_size: int, shard_tokens: int = SHARD_TOKENS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write a split's stream in shards of about ``shard_tokens`` tokens and return their metadata.

    ``encoded`` holds split, tokens, tok_start. A shard has the records that start in
    its stretch of the stream: ids as 16-bit unsigned little-endian bytes in the
    column ``packed``, in rows of at most ``chunk_bytes`` that ``chunk`` counts. Its
    sha256 stands in the last of them and is that of all bytes in order. Fails where
    ids don't fit 16 bits. Records are packed where they are, sorted by Spark, and
    written as they come, so a task holds a batch and a chunk, however large a shard.
    """
    if vocab_size > 65_535:
        raise ValueError(f"{vocab_size} ids do not fit 16 bits")
    bounded_batches(encoded.sparkSession)
    shard = F.floor(F.col("tok_start") / shard_tokens).alias("shard")
    packed = encoded.select("split", shard, "tok_start", "tokens").mapInArrow(_packed, "split string, shard long, tok_start long, n long, unknown long, raw binary")
    ordered = packed.repartition("split", "shard").sortWithinPartitions("split", "shard", "tok_start", "n")
    chunks = ordered.mapInArrow(_chunks(chunk_bytes), "split string, shard long, chunk int, records long, n_tokens long, unknown_tokens long, packed binary, sha256 string")
    chunks.write.partitionBy("split").parquet(path)
    written = encoded.sparkSession.read.parquet(path)
    sums = [F.sum(c).alias(c) for c in ("records", "n_tokens", "unknown_tokens")]
    return written.groupBy("split", "shard").agg(*sums, F.sum(F.octet_length("packed")).cast("long").alias("bytes"), F.max("sha256").alias("sha256"))


def check_vocab(vocab: DataFrame) -> None:
    """Raise unless the specials come first and tokens and ids are distinct; reads two tiny results."""
    first = [r.token for r in vocab.where(F.col("id") < len(SPECIALS)).orderBy("id").select("token").collect()]
    n, names, ids, top = vocab.agg(F.count("*"), F.count_distinct("token"), F.count_distinct("id"), F.max("id")).first()
    if tuple(first) != SPECIALS or not n == names == ids == top + 1:
        raise ValueError("specials must come first and tokens must be distinct")


def save_vocab(vocab: DataFrame, path: str) -> None:
    check_vocab(vocab)
    vocab.write.parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    vocab = spark.read.schema("token string, id int, count long").parquet(path)
    check_vocab(vocab)
    return vocab


def artifact_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
