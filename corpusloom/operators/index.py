"""Numbering and running sums in a total order without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.shared import materialize

#: About so many rows of one bucket are numbered in one task; a larger table has more buckets.
BUCKET_ROWS = 1 << 16


def hash_bucket(hex_hash: Column, rows: int = 0) -> Column:
    """The first hexadecimal digits as a number: buckets in the order of the hash, enough for so many rows.

    Two digits make 256 buckets; a fifth one is the last, with a million buckets.
    """
    digits = 2
    while digits < 5 and rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return F.conv(F.substring(hex_hash, 1, digits), 16, 10).cast("int")


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` written in ranges of its total order, with __range and __place, each row's place in its range from 0.

    Spark draws the limits of the ranges from a bounded sample and finds each row's
    range by binary search; no limit becomes part of a plan. A range is one task's
    sort. Rows that are equal in all of ``order`` share a range and have some order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    # A monotonic id counts rows in its low 33 bits and tasks above; written, it stays as it is.
    return numbered.withColumns({"__range": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND((1 << 33) - 1)}).drop("__at")


def range_starts(totals: DataFrame, key: str, total: str) -> DataFrame:
    """``key`` and __start, the sum of ``total`` over smaller keys; a row for each range or file split, so it is small."""
    upto = Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return totals.select(key, (F.sum(total).over(upto) - F.col(total)).alias("__start"))


def prefix_sum(df: DataFrame, order: list[str], value: Column, out: str, by: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each row in ``order``, within ``by``.

    Two levels: rows are summed inside buckets, which are monotone in the order, and
    each bucket's start is the sum of the totals before it. ``bucket`` says which one
    a row is in; without it, rows are written in ranges of their order. Totals are one
    row for each bucket, of which there are at most a million, so they are broadcast.
    """
    by = by or []
    if bucket is None:
        ranged = in_ranges(df, [*by, *order])
        return prefix_sum(ranged, ["__place"], value, out, by, F.col("__range")).drop("__range", "__place")
    keyed = T.bind(df, __bucket=bucket, __value=value.cast("long"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = keyed.groupBy(*by, "__bucket").agg(F.sum("__value").alias("__total"))
    across = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = totals.withColumn("__start", F.sum("__total").over(across) - F.col("__total")).drop("__total")
    placed = keyed.join(F.broadcast(starts), [*by, "__bucket"])
    return placed.withColumn(out, F.col("__start") + F.sum("__value").over(inside) - F.col("__value")).drop("__bucket", "__value", "__start")


def global_index(df: DataFrame, order: list[str], out: str, start: int = 1, bucket: Column | None = None) -> DataFrame:
    """``df`` with its contiguous ordinal in the total order of ``order``, counted from ``start``.

    Without a ``bucket`` rows move once, into ranges of their order, and the counts of
    the ranges number them; nulls come first, ties have some order.
    """
    if bucket is not None:
        return prefix_sum(df, order, F.lit(1), out, bucket=bucket).withColumn(out, F.col(out) + start)
    ranged = in_ranges(df, order)
    starts = range_starts(ranged.groupBy("__range").agg(F.count("*").alias("__n")), "__range", "__n")
    return ranged.join(F.broadcast(starts), "__range").withColumn(out, F.col("__start") + F.col("__place") + start).drop("__range", "__place", "__start")
