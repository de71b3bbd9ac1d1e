"""Raw text files as numbered blocks, and a gate for bytes that are not UTF-8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.index import global_index, prefix_sum
from corpusloom.sources.shared import materialize


def read_text_blocks(spark: SparkSession, path: str, line_sep: str = "\n\n") -> DataFrame:
    """file_path, block_start, pos, block, block_number of blocks that hold more than white space.

    Blocks are numbered from 1 in the order of file, split and position. Spark cuts
    the files at ``line_sep``; a file's last line break stays on its last block. A
    task reads a split in order and counts its blocks as they come, so all that is
    summed are the splits' counts, a few numbers each, and no block is sorted or moved.
    """
    rows = _pieces(spark, path, line_sep).where(~T.is_blank(F.col("value"))).withColumnRenamed("value", "block").withColumn("pos", F.monotonically_increasing_id())
    rows = rows.withColumn("__split", F.xxhash64("file_path", "block_start"))
    splits = rows.groupBy("__split", "file_path", "block_start").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file_path", "block_start").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = splits.select("__split", (before + 1 - F.col("first")).alias("__start"))
    placed = rows.join(F.broadcast(starts), "__split")  # two numbers for each split of the files
    return placed.select("file_path", "block_start", "pos", "block", (F.col("pos") + F.col("__start")).alias("block_number"))


def _pieces(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """file_path, block_start, pos, value of what lies between separators; without one, of lines."""
    read = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    return read.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("pos"), "value")


def _in_splits(rows: DataFrame) -> DataFrame:
    """``rows`` with __split, the rank of each row's stretch of a file: a row for each stretch is ranked."""
    splits = rows.select("file_path", "block_start").distinct()
    ranked = splits.withColumn("__split", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("file_path", "block_start")))
    return rows.join(F.broadcast(ranked), ["file_path", "block_start"])


def read_mixed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The same for files whose lines end in CRLF, CR or LF: line breaks inside a block become LF.

    Files are read by line. Running counts of empty and of other lines say which
    lines make a block, so neither a file nor its numbering gathers in one task. Two
    line breaks separate; an odd one is left on the block after it, as a cut of the
    whole text leaves it. The line break at the end of a file is dropped.
    """
    lines = materialize(_in_splits(_pieces(spark, path)), "lines")
    order = ["__split", "pos"]
    counted = prefix_sum(lines, order, (F.col("value") == "").cast("int"), "empty_before", bucket=F.col("__split"))
    counted = materialize(prefix_sum(counted, order, (F.col("value") != "").cast("int"), "full_before", bucket=F.col("__split")), "lines")
    first = counted.groupBy("file_path").agg(F.min("full_before").alias("file_start"))
    gaps = counted.where("value = ''").groupBy("file_path", "full_before").agg(F.count("*").alias("k"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("full_before", "value"))), lambda x: x["value"])
    blocks = counted.where("value <> ''").groupBy("file_path", "empty_before").agg(F.array_join(parts, "\n").alias("block"), F.min("full_before").alias("full_before"), F.min(F.struct("__split", "block_start", "pos")).alias("at"))
    placed = blocks.join(gaps, ["file_path", "full_before"], "left").join(F.broadcast(first), "file_path")
    breaks = F.coalesce("k", F.lit(0)) + (F.col("full_before") > F.col("file_start")).cast("int")
    odd = (breaks > F.when(F.col("full_before") > F.col("file_start"), 1).otherwise(0)) & (breaks % 2 == 1)
    rows = placed.select("file_path", "at.*", F.concat(F.when(odd, "\n").otherwise(""), "block").alias("block")).where(~T.is_blank(F.col("block")))
    return global_index(rows, order, "block_number", bucket=F.col("__split")).drop("__split")


def utf8_gate(binary: DataFrame, content: str = "content", strict: bool = False) -> DataFrame:
    """``binary`` with ``text`` and ``is_utf8``; bad bytes have a null text, or fail the job if ``strict``."""
    text = F.col(content).cast("string")
    if strict:
        return binary.withColumn("text", F.validate_utf8(text)).withColumn("is_utf8", F.lit(True))
    return binary.withColumn("text", F.try_validate_utf8(text)).withColumn("is_utf8", F.is_valid_utf8(text))
