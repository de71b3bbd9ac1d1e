"""The whole preparation: normalise, parse, deduplicate, route, split, label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import clean, dedup, forms, parse, split
from corpusloom.operators.normalize import normalize_text, separated_blocks
from corpusloom.policy import Policies
from corpusloom.sources.shared import materialize


@dataclass
class Prepared:
    """The tables of a run, read from what its two writing passes over the texts left."""

    parsed: DataFrame
    records: DataFrame
    unique: DataFrame
    routed: DataFrame
    clean: DataFrame
    splits: DataFrame
    labelled: DataFrame


def prepare_corpus(blocks: DataFrame, policy: Policies, seed: int = 42, kind: str | None = None) -> Prepared:
    """``blocks`` holds block_number and block, in the order of block_number.

    A block that falls apart in normalisation keeps its number for its first part
    only; parts after it have no place of their own in the numbering and are numbered
    after all others by (block_number, part).

    With several policies, the column ``kind`` of ``blocks`` names each block's; its
    rules parse, route and label what comes of the block, all kinds in one pass.

    Two passes read and write texts: blocks become parsed records with fingerprints,
    and the first of each fingerprint become routed records with their form. What
    lies between compares keys only.
    """
    named, of = [kind] * bool(kind), F.col(kind) if kind else None
    normal = separated_blocks(blocks.select("block_number", *named, normalize_text(F.col("block"), policy, of).alias("block")), "block")
    title, text = F.col("title"), F.col("text")
    parsed = T.bind(parse.parse_blocks(normal, policy, kind=kind), fingerprint=dedup.fingerprint(title, text), body_fingerprint=dedup.body_fingerprint(text))
    parsed = materialize(parsed, "parsed")
    records = parse.accepted(parsed)
    keyed = parsed.where("status = 'accepted'").select(*parse.accepted_columns(), "fingerprint", "body_fingerprint", *named)
    unique = dedup.dedup_keep_first(keyed, "fingerprint").drop("fingerprint")
    routed = clean.route_by_quality(unique, policy, kind=kind)
    marked = materialize(T.bind(routed, form=forms.label_form(text, policy, of)).drop(*named), "routed")
    clean_ones = marked.where("status = 'clean'")
    splits = split.group_split(clean_ones.select(*records.columns, "body_fingerprint", "form"), "body_fingerprint", seed=seed)
    return Prepared(parsed, records, unique.drop("body_fingerprint", *named), marked.drop("body_fingerprint", "form"), clean_ones.select(records.columns), splits.drop("form"), splits)


def stage_funnel(stages: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(place, stage, rows_in, rows_out) of named pairs of tables, one count each."""
    out = None
    for i, (name, before, after) in enumerate(stages):
        row = before.agg(F.count("*").alias("rows_in")).crossJoin(after.agg(F.count("*").alias("rows_out")))  # one row each
        row = row.select(F.lit(i).alias("place"), F.lit(name).alias("stage"), "rows_in", "rows_out")
        out = row if out is None else out.unionByName(row)
    return out


def funnel(prepared: Prepared) -> DataFrame:
    """The funnel of a preparation in three passes, one for each table that two stages share."""
    parsed = prepared.parsed.agg(F.count("*").alias("blocks"), F.count_if(F.col("status") == "accepted").alias("records"))
    routed = prepared.routed.agg(F.count("*").alias("unique"), F.count_if(F.col("status") == "clean").alias("clean"))
    labelled = prepared.labelled.agg(F.count("*").alias("splits"), F.count("form").alias("labelled"))
    counts = parsed.crossJoin(routed).crossJoin(labelled)  # one row each
    stages = [("parse", "blocks", "records"), ("dedup", "records", "unique"), ("route", "unique", "clean"), ("split", "clean", "splits"), ("label", "splits", "labelled")]
    rows = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("stage"), F.col(a).alias("rows_in"), F.col(b).alias("rows_out")) for i, (n, a, b) in enumerate(stages)]
    return counts.select(F.inline(F.array(*rows)))
