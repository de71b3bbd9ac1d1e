"""Blocks of four lines to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.policy import Policies, by_kind


def parse_blocks(blocks: DataFrame, policy: Policies, block: str = "block", number: str = "block_number", kind: str | None = None) -> DataFrame:
    """One row for each block with ``status`` accepted or rejected; see ``accepted`` and ``rejected``.

    A block has title, category with a closing bracket, author and text on four
    physical lines. One trailing bracket goes; category and author may be empty. With
    several policies, ``kind`` is the column that names each block's and passes.
    """
    split = T.bind(blocks.select(F.col(number).cast("long").alias("source_block"), F.col(block).alias("__block"), *[kind] * bool(kind)), raw_lines=T.physical_lines(F.col("__block"))).drop("__block")
    four = F.size("raw_lines") == 4
    field = lambda i: F.when(four, T.strip(F.get("raw_lines", F.lit(i))))
    fields = T.bind(split, title=field(0), marked=field(1), author=field(2), text=field(3))
    reason = F.concat_ws(",", F.when(~four, "physical_line_count_not_4"), F.when(F.col("title") == "", "empty_title"), F.when(F.col("text") == "", "empty_body"))
    bracketed = F.col("marked").endswith("]")
    category = T.strip(F.when(bracketed, F.expr("left(marked, length(marked) - 1)")).otherwise(F.col("marked")))
    out = T.bind(fields, reason=reason, category=category).withColumn("unbracketed", ~bracketed)
    out = out.withColumn("status", F.when(F.col("reason") == "", "accepted").otherwise("rejected"))
    return out.withColumn("id", by_kind(policy, F.col(kind) if kind else None, lambda p: F.format_string(p.id_format, "source_block"))).withColumn("physical_line_count", F.size("raw_lines").cast("long"))


def accepted_columns() -> list[Column | str]:
    return ["id", "title", F.col("category").alias("dynasty"), "author", "text", "source_block"]


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("status = 'accepted'").select(*accepted_columns())


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("status = 'rejected'").select("source_block", "reason", "physical_line_count", "raw_lines")


def parse_summary(parsed: DataFrame) -> DataFrame:
    """One row of counts; accepted + rejected = total."""
    good = F.col("status") == "accepted"
    return parsed.agg(
        F.count("*").alias("total"),
        F.count_if(good).alias("accepted"),
        F.count_if(~good).alias("rejected"),
        F.coalesce(F.sum(F.when(good, F.length("text"))), F.lit(0)).alias("body_characters"),
        F.count_if(good & (F.col("category") == "")).alias("empty_category"),
        F.count_if(good & (F.col("author") == "")).alias("empty_author"),
        F.count_if(good & F.col("unbracketed")).alias("category_without_bracket"),
    )
