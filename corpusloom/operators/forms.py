"""Strict structural forms: so many clauses of one width with alternating marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import unicode_classes as U
from corpusloom.policy import Policies, Policy, by_kind


def form_pattern(clauses: int, width: int, policy: Policy) -> str:
    half = f"{U.HAN}{{{width}}}"
    return rf"\A(?:{half}{policy.form_comma}{half}[{policy.form_stops}]){{{clauses // 2}}}\z"


def label_form(text: Column, policy: Policies, kind: Column | None = None) -> Column:
    """The form's name, or null for anything else, as under a policy without forms."""
    none = F.lit(None).cast("string")
    return by_kind(policy, kind, lambda p: F.coalesce(*(F.when(text.rlike(form_pattern(n, w, p)), F.lit(name)) for n, w, name in p.forms), none))


def keep_labelled(df: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    return df.withColumn("form", label_form(F.col(text), policy)).where("form is not null")


def form_counts(labelled: DataFrame) -> DataFrame:
    """(split, form, n) with totals, shown as <ALL>, for each split and overall."""
    rows = labelled.rollup("split", "form").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("split", F.lit("<ALL>")).alias("split"), F.coalesce("form", F.lit("<ALL>")).alias("form"), "n")


def verify_form(requested: DataFrame, policy: Policy, form: str = "form", text: str = "text") -> DataFrame:
    """(form, texts, passed): whether texts have the form that was asked of them."""
    passed = F.coalesce(label_form(F.col(text), policy) == F.col(form), F.lit(False))
    return requested.groupBy(form).agg(F.count("*").alias("texts"), F.count_if(passed).alias("passed"))
