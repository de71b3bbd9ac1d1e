"""Structural and content validation of record lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import unicode_classes as U
from corpusloom.policy import Policy
from corpusloom.sources.shared import materialize

#: Required fields and the variant types that each accepts. A boolean passes as an integer, 1.0 does not.
REQUIRED = {"id": ("STRING",), "title": ("STRING",), "dynasty": ("STRING",), "author": ("STRING",), "text": ("STRING",), "source_block": ("BIGINT", "BOOLEAN")}
EXCERPT = 500


def validate_structure(lines: DataFrame, required: dict[str, tuple[str, ...]] = REQUIRED, value: str = "value", number: str = "line_number") -> DataFrame:
    """line_number, reasons, error, raw_excerpt and the required fields of each line.

    Reasons: invalid_json, record_not_object, missing_field:x, wrong_type:x. Lines
    with duplicate keys or NaN count as invalid JSON.
    """
    # Generated rows: the text of a line is parsed once, each field looked up once for its type and once for its value.
    parsed = T.bind(lines.select(F.col(number).alias("line_number"), F.col(value).alias("value")), v=F.try_parse_json("value"))
    parsed = T.bind(parsed, is_object=F.schema_of_variant("v").startswith("OBJECT"))
    part = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    typed = T.bind(parsed, kinds=F.struct(*(F.when(F.col("is_object"), F.schema_of_variant(part(name))).alias(name) for name in required)))
    kind = lambda name: F.col(f"kinds.{name}")
    missing = T.reasons((f"missing_field:{name}", F.col("is_object") & kind(name).isNull()) for name in required)
    wrong = T.reasons((f"wrong_type:{name}", kind(name).isNotNull() & ~kind(name).isin(*kinds)) for name, kinds in required.items())
    found = F.when(F.col("v").isNull(), F.array(F.lit("invalid_json"))).when(~F.col("is_object"), F.array(F.lit("record_not_object"))).otherwise(F.concat(missing, wrong))
    kept = {name: F.when(F.size("reasons") == 0, F.try_variant_get("v", f"$.{name}", "string" if kinds == ("STRING",) else "bigint")) for name, kinds in required.items()}
    out = T.bind(typed, reasons=found)
    error = F.when(F.col("v").isNull(), F.lit("invalid_json")).otherwise(F.lit(None).cast("string"))
    return out.select("line_number", "reasons", error.alias("error"), F.when(F.size("reasons") > 0, F.substring("value", 1, EXCERPT)).alias("raw_excerpt"), *(c.alias(n) for n, c in kept.items()))


def first_lines(records: DataFrame, order: str = "line_number") -> DataFrame:
    """kind (0: id, 1: source_block), key and first of the keys that occur again, written.

    Both keys of a row go through one exchange as narrow rows, summed up before it, so
    a hot key is a row for each task.
    """
    keys = F.array(F.struct(F.lit(0).alias("kind"), F.col("id").alias("key")), F.struct(F.lit(1).alias("kind"), F.col("source_block").cast("string").alias("key")))
    rows = records.select(F.col(order).alias("__line"), F.inline(keys)).where("key is not null")
    firsts = rows.groupBy("kind", "key").agg(F.min("__line").alias("first"), F.count("*").alias("n")).where("n > 1")
    return materialize(firsts.drop("n"), "firsts")


def duplicate_key_flags(records: DataFrame, policy: Policy, order: str = "line_number") -> DataFrame:
    """Adds ``key_reasons``: duplicate_id and duplicate_source_block from the second occurrence on, invalid_id_format.

    ``records`` is read twice, its keys first, so it should be written. Rows meet only
    the keys that occur again.
    """
    firsts = first_lines(records, order)
    first_id = firsts.where("kind = 0").select(F.col("key").alias("id"), F.col("first").alias("__first_id"))
    first_block = firsts.where("kind = 1").select(F.col("key").cast("long").alias("source_block"), F.col("first").alias("__first_block"))
    joined = records.join(first_id, "id", "left").join(first_block, "source_block", "left")
    rules = [("duplicate_id", F.col(order) > F.col("__first_id")), ("invalid_id_format", ~F.col("id").rlike(policy.id_pattern)), ("duplicate_source_block", F.col(order) > F.col("__first_block"))]
    return joined.withColumn("key_reasons", T.reasons(rules)).select(*map(T.named, records.columns), "key_reasons")


def content_reasons(policy: Policy, title: Column, category: Column, author: Column, text: Column) -> Column:
    """Ordered flags of suspicious content; length flags add up."""
    everything = F.concat(title, category, author, text)
    size, solid = F.length(text), F.length(T.compact(text))
    rules = [
        ("empty_title", T.is_blank(title)),
        ("empty_body", T.is_blank(text)),
        ("empty_dynasty", T.is_blank(category)),
        ("unknown_dynasty", ~T.is_blank(category) & ~category.isin(*policy.known)),
        ("empty_author", T.is_blank(author)),
        (f"body_shorter_than_{policy.min_length}", size < policy.min_length),
        (f"body_longer_than_{policy.note_length}", size > policy.note_length),
        (f"body_longer_than_{policy.review_length}", size > policy.review_length),
        (f"body_longer_than_{policy.max_length}", size > policy.max_length),
        ("unicode_replacement_character", F.contains(everything, F.lit("�"))),
        ("unexpected_control_character", everything.rlike(U.CONTROL)),
        ("possible_html", text.rlike(policy.html)),
        ("contains_url", text.rlike(f"(?iu){policy.url}")),
    ]
    if policy.latin_rules:
        rules += [
            ("latin_heavy_body", (solid >= policy.latin_least) & (T.latin_count(text) > policy.latin_share * solid)),
            ("latin_heavy_prefix", T.latin_count(F.substring(text, 1, policy.prefix_length)) >= policy.prefix_latin),
        ]
    rules += [(f"contains_marker:{m}", F.contains(text, F.lit(m))) for m in policy.validation_markers]
    return T.reasons(rules)


def validate(lines: DataFrame, policy: Policy) -> DataFrame:
    """Structure, keys and content of every line: line_number, reasons, error, raw_excerpt, record fields.

    Lines are read and parsed once and written with what structure and content say;
    the keys are then read from there.
    """
    valid = F.size("reasons") == 0
    content = content_reasons(policy, F.col("title"), F.col("dynasty"), F.col("author"), F.col("text"))
    parsed = materialize(T.bind(validate_structure(lines), content=F.when(valid, content)), "validated")
    flagged = duplicate_key_flags(parsed, policy)
    return flagged.withColumn("structural", ~valid).withColumn("reasons", F.when(valid, F.concat("key_reasons", "content")).otherwise(F.col("reasons"))).drop("content")


def suspicious_records(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") > 0).drop("structural", "key_reasons")


def validation_summary(validated: DataFrame) -> DataFrame:
    """One row of counts over validated lines."""
    good, has = ~F.col("structural"), lambda r: F.array_contains("reasons", r)
    size = F.when(good, F.length("text"))
    return validated.agg(
        F.count("*").alias("lines"),
        F.count_if(good).alias("valid_records"),
        F.count_if(has("invalid_json")).alias("json_errors"),
        F.count_if(~good & ~has("invalid_json")).alias("schema_errors"),
        F.count_if(has("duplicate_id")).alias("duplicate_ids"),
        F.count_if(has("duplicate_source_block")).alias("duplicate_source_blocks"),
        F.count_if(F.size("reasons") > 0).alias("suspicious"),
        F.coalesce(F.min(size), F.lit(0)).cast("long").alias("shortest"),
        F.coalesce(F.max(size), F.lit(0)).cast("long").alias("longest"),
    )


def assert_blocking(summary: DataFrame) -> None:
    """Raise where a structural count is not 0; reads the one row of a summary."""
    row = summary.first().asDict()
    bad = {k: row[k] for k in ("json_errors", "schema_errors", "duplicate_ids", "duplicate_source_blocks") if row[k]}
    if bad:
        raise ValueError(f"validation failed: {bad}")
