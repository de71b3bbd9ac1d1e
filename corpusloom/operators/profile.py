"""Profiles of a raw corpus."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import unicode_classes as U


def corpus_totals(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: bytes, characters, lines, non-empty and blank lines, distinct, replacement and control characters."""
    t = F.col(text)
    lines = T.physical_lines(t)
    full = F.filter(lines, lambda x: x.rlike(U.NOT_WS))
    sums = df.agg(
        F.sum(F.octet_length(t)).alias("bytes"),
        F.sum(F.length(t)).alias("characters"),
        F.sum(F.size(lines)).alias("lines"),
        F.sum(F.size(full)).alias("nonempty_lines"),
        F.sum(F.size(lines) - F.size(full)).alias("blank_lines"),
        F.sum(T.matches(t, "�")).alias("replacement_characters"),
        F.sum(T.matches(t, U.CONTROL)).alias("control_characters"),
    )
    distinct = char_frequency(df, text).agg(F.count("*").alias("distinct_characters"))
    return sums.crossJoin(distinct)  # one row each


def field_count_histogram(blocks: DataFrame, block: str = "block") -> DataFrame:
    """(section, key, blocks): blocks by non-empty fields and by physical lines, and the malformed total."""
    counted = blocks.select(F.size(T.field_lines(F.col(block))).alias("fields"), F.size(T.physical_lines(F.col(block))).alias("lines"))
    rows = counted.select(F.explode(F.array(F.struct(F.lit("fields").alias("section"), F.col("fields").alias("key")), F.struct(F.lit("lines").alias("section"), F.col("lines").alias("key")))).alias("r"), (F.col("fields") != 4).alias("bad"))
    by_key = rows.groupBy(F.col("r.section").alias("section"), F.col("r.key").cast("long").alias("key")).agg(F.count("*").alias("blocks"))
    malformed = counted.agg(F.count_if(F.col("fields") != 4).alias("blocks")).select(F.lit("malformed").alias("section"), F.lit(-1).cast("long").alias("key"), "blocks")
    return by_key.unionByName(malformed)


def length_stats(df: DataFrame, text: str = "text", under: tuple[int, ...] = (8,), over: tuple[int, ...] = (500, 1000, 5000), fractions: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row: min, mean, percentiles, max and counts beyond thresholds of text lengths.

    A percentile is the length at index int((n - 1) * fraction), found in the
    histogram of lengths, which is small, so texts are never sorted.
    """
    histogram = df.groupBy(F.length(text).cast("long").alias("length")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("length").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    ranked = histogram.select("length", "n", upto.alias("upto"), total.alias("total"))
    return ranked.agg(
        F.sum("n").alias("texts"),
        F.min("length").alias("shortest"),
        F.round(F.sum(F.col("length") * F.col("n")) / F.sum("n"), 6).alias("mean"),
        *(F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * f), F.col("length"))).alias(f"p{round(f * 100)}") for f in fractions),
        F.max("length").alias("longest"),
        *(F.sum(F.when(F.col("length") < n, F.col("n")).otherwise(0)).alias(f"under_{n}") for n in under),
        *(F.sum(F.when(F.col("length") > n, F.col("n")).otherwise(0)).alias(f"over_{n}") for n in over),
    )


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """(category, n): frequencies, empty shown as <EMPTY>, most frequent first, then by name."""
    shown = F.when(F.coalesce(F.col(column), F.lit("")) == "", "<EMPTY>").otherwise(F.col(column))
    return df.groupBy(shown.alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def marker_counts(df: DataFrame, markers: tuple[str, ...], text: str = "text") -> DataFrame:
    """(marker, n): non-overlapping occurrences of each literal over all texts, each marker on its own."""
    sums = df.agg(*(F.coalesce(F.sum(T.occurrences(F.col(text), m)), F.lit(0)).alias(f"m{i}") for i, m in enumerate(markers)))
    pairs = F.array(*(F.struct(F.lit(m).alias("marker"), F.col(f"m{i}").alias("n")) for i, m in enumerate(markers)))
    return sums.select(F.inline(pairs))


def longest_records(df: DataFrame, k: int = 20, text: str = "text", number: str = "source_block", title: str = "title") -> DataFrame:
    """The k longest: length, number and title, descending in this order."""
    return df.select(F.length(text).cast("long").alias("length"), F.col(number).alias("block"), F.col(title).alias("title")).orderBy(F.desc("length"), F.desc("block"), F.desc("title")).limit(k)


def malformed_examples(blocks: DataFrame, k: int = 20, block: str = "block", number: str = "block_number") -> DataFrame:
    """The first k blocks without four fields: number, field count, first field cut to 80 characters."""
    fields = T.field_lines(F.col(block))
    found = blocks.select(F.col(number).alias("block"), F.size(fields).cast("long").alias("fields"), F.coalesce(F.substring(F.get(fields, F.lit(0)), 1, 80), F.lit("")).alias("first_field"))
    return found.where("fields <> 4").orderBy("block").limit(k)


def _partial_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of code points in each Arrow batch: as many rows as distinct characters."""
    for batch in batches:
        joined = "".join(batch.iloc[:, 0].dropna())
        code, n = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
        yield pd.DataFrame({"code": code.astype("int64"), "n": n.astype("int64")})


def code_point_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(code, n) of every code point."""
    return df.select(F.col(text).cast("string")).mapInPandas(_partial_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def from_code(code: Column) -> Column:
    """The character of a code point."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    tail = lambda shift: byte(F.lit(0x80).bitwiseOR(F.shiftright(code, shift).bitwiseAND(F.lit(0x3F))))
    utf8 = (
        F.when(code < 0x80, byte(code))
        .when(code < 0x800, F.concat(byte(F.lit(0xC0).bitwiseOR(F.shiftright(code, 6))), tail(0)))
        .when(code < 0x10000, F.concat(byte(F.lit(0xE0).bitwiseOR(F.shiftright(code, 12))), tail(6), tail(0)))
        .otherwise(F.concat(byte(F.lit(0xF0).bitwiseOR(F.shiftright(code, 18))), tail(12), tail(6), tail(0)))
    )
    return F.decode(F.unhex(utf8), "UTF-8")


def char_frequency(df: DataFrame, text: str = "text", k: int | None = None) -> DataFrame:
    """(character, n), most frequent first, then by code point; the first k of them if asked."""
    counts = code_point_counts(df, text).select(from_code(F.col("code")).alias("character"), "n")
    return counts.orderBy(F.desc("n"), "character").limit(k) if k else counts


_SHOWN = {"\n": r"\n", "\r": r"\r", "\t": r"\t", " ": "<SPACE>"}


def named_characters(top: DataFrame) -> DataFrame:
    """Adds the visible form and the Unicode name to the few rows of a top-k report."""
    names = [(r.character, _SHOWN.get(r.character, r.character), unicodedata.name(r.character, "")) for r in top.select("character").limit(1000).collect()]
    return top.join(F.broadcast(top.sparkSession.createDataFrame(names, "character string, shown string, name string")), "character")
