"""Exact deduplication by fingerprint, with an audit of what went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def fingerprint(title: Column, text: Column) -> Column:
    """SHA-256 of title and text without white space."""
    return F.sha2(F.concat(T.compact(title), F.lit("\n"), T.compact(text)).cast("binary"), 256)


def body_fingerprint(text: Column) -> Column:
    return F.sha2(T.compact(text).cast("binary"), 256)


def _first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The least ``order`` of each key, summed up in the tasks first, so that a hot key is no burden."""
    return df.groupBy(key).agg(F.min(order).alias("__first"))


def dedup_keep_first(df: DataFrame, key: str, order: str = "source_block") -> DataFrame:
    """The row of least ``order`` for each key; texts move by one semi join."""
    first = _first(df.select(key, order), key, order).select(key, F.col("__first").alias(order))
    return df.join(first, [key, order], "left_semi")


def duplicate_audit(df: DataFrame, key: str, order: str = "source_block", compare: tuple[str, ...] = ("dynasty", "author"), id_col: str = "id") -> DataFrame:
    """Each removed row with the kept row's id and block, and the fields that differ from the kept row's."""
    kept = dedup_keep_first(df.select(key, order, id_col, *compare), key, order)
    kept = kept.select(key, F.col(id_col).alias("kept_id"), F.col(order).alias("kept_source_block"), *(F.col(c).alias(f"__kept_{c}") for c in compare))
    pairs = df.join(kept, key).where(F.col(order) > F.col("kept_source_block"))
    conflicts = T.reasons((c, ~F.col(c).eqNullSafe(F.col(f"__kept_{c}"))) for c in compare)
    record = F.struct(*(T.named(c) for c in df.columns if c != key))
    return pairs.select(F.col(key).alias("fingerprint"), "kept_id", "kept_source_block", F.col(id_col).alias("removed_id"), F.col(order).alias("removed_source_block"), conflicts.alias("metadata_conflicts"), record.alias("removed_record"))


def dedup_summary(df: DataFrame, key: str, audit: DataFrame, compare: tuple[str, ...] = ("dynasty", "author")) -> DataFrame:
    """One row: input, retained, removed, duplicate groups, largest group, conflicts by field."""
    groups = df.groupBy(key).agg(F.count("*").alias("n"))
    sizes = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input"),
        F.count("*").alias("retained"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.max("n"), F.lit(1)).alias("largest_group"),
    )
    conflicts = audit.agg(*(F.count_if(F.array_contains("metadata_conflicts", c)).alias(f"{c}_conflicts") for c in compare))
    return sizes.crossJoin(conflicts)  # one row each


def same_body_different_title(df: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """Bodies under more than one title: body fingerprint, titles, records."""
    keyed = df.select(body_fingerprint(F.col(text)).alias("body_fingerprint"), T.compact(F.col(title)).alias("title"))
    return keyed.groupBy("body_fingerprint").agg(F.count_distinct("title").alias("titles"), F.count("*").alias("records")).where("titles > 1")
