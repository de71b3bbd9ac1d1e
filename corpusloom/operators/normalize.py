"""Normalisation of raw text and its statistics."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import text as T
from corpusloom.functions import unicode_classes as U
from corpusloom.policy import Policies, Policy, by_kind

BOM, NUL = "﻿", "\x00"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Composed form. Spark has none built in; texts without a character from U+0300 on cannot change."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[\x{300}-\x{10ffff}]"), text)), text)


def line_feeds(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _mapped(text: Column, policy: Policy) -> Column:
    """Without BOM and NUL, punctuation mapped."""
    return F.translate(text, "".join(policy.punctuation) + BOM + NUL, "".join(policy.punctuation.values()))


def _stripped_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda line: T.let(T.strip(line), lambda bare: F.when(bare == "", line).otherwise(bare)))


def normalize_text(text: Column, policy: Policies, kind: Column | None = None) -> Column:
    """Line feeds, NFC, no BOM or NUL, mapped punctuation, stripped lines, at most one empty line, stripped ends.

    Lines of white space only stay as they are: they are empty fields, not separators.
    """
    composed = nfc(line_feeds(text))
    lines = F.array_join(_stripped_lines(by_kind(policy, kind, lambda p: _mapped(composed, p))), "\n")
    return T.strip(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def normalization_stats(df: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """(statistic, n): what normalisation changes, and sizes before and after."""
    source = df.select(F.col(text).alias("raw"))
    # Each step once, as a column of its own.
    steps = T.bind(T.bind(source, lf=line_feeds(F.col("raw"))).withColumn("composed", nfc(F.col("lf"))), mapped=_mapped(F.col("composed"), policy))
    steps = T.bind(T.bind(steps, before=F.split("mapped", "\n", -1), after=_stripped_lines(F.col("mapped"))), joined=F.array_join("after", "\n"))
    steps = T.bind(steps, done=T.strip(F.regexp_replace("joined", "\n{3,}", "\n\n")))
    crlf, cr = T.matches(F.col("raw"), "\r\n"), T.matches(F.col("raw"), "\r")
    pairs = F.arrays_zip(F.col("before").alias("b"), F.col("after").alias("a"))
    long = F.regexp_extract_all("joined", F.lit("(\n{3,})"), F.lit(1))
    blocks = lambda c: F.size(F.filter(F.split(c, "\n\n", -1), lambda b: b.rlike(U.NOT_WS)))
    values = {
        "crlf": crlf,
        "bare_cr": cr - crlf,
        "nfc_changed": (F.col("lf") != F.col("composed")).cast("long"),
        "nfc_delta": F.length("composed") - F.length("lf"),
        "bom": T.matches(F.col("composed"), BOM),
        "nul": T.matches(F.col("composed"), r"\x00"),
        "blank_lines_kept": F.size(F.filter("before", lambda x: (x != "") & T.is_blank(x))),
        "lines_trimmed": F.size(F.filter(pairs, lambda p: p["b"] != p["a"])),
        "characters_trimmed": F.length("mapped") - F.length("joined"),
        "extra_newlines": F.aggregate(long, F.lit(0), lambda n, x: n + F.length(x) - 2),
        "characters_before": F.length("raw"),
        "characters_after": F.length("done"),
        "lines_before": F.size(T.physical_lines(F.col("raw"))),
        "lines_after": F.size(T.physical_lines(F.col("done"))),
        "blocks_before": blocks(F.col("raw")),
        "blocks_after": blocks(F.col("done")),
        **{f"replaced_{ord(c):04X}": T.occurrences(F.col("composed"), c) for c in policy.punctuation},
    }
    sums = steps.agg(*(F.sum(v).cast("long").alias(k) for k, v in values.items()))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("statistic"), F.col(k).alias("n")) for k in values))))


def separated_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each block of a normalised text, in order: deleting a BOM line can make a new separator."""
    rest = [F.col(T.named(c)) for c in df.columns if c != text]
    parts = df.select(*rest, F.posexplode(F.split(text, "\n{2,}", -1)).alias("part", "block"))
    return parts.where(~T.is_blank(F.col("block")))
