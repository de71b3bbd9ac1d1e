"""A query for each operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import clean, dedup, forms, index, normalize, parse, profile, split, tokens, validate, windows
from corpusloom.plans import prepare
from corpusloom.plans.views import view
from corpusloom.policy import CLASSICAL, LATIN_SCRIPT
from corpusloom.sources import records as record_files
from corpusloom.sources import text as text_files
from corpusloom.sources.shared import materialize, new_path
from corpusloom.sources.tables import read_spread

Query = Callable[[SparkSession, str], DataFrame]
BLOCK, SAMPLES = 256, 50
STRIDE = BLOCK  # windows tile the whole stream
#: Small, so that even a small table makes several shards and files.
SHARD_TOKENS, FILE_RECORDS = 50_000, 100
SAMPLE_SIZES = {"train": 30, "validation": 20, "test": 20}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_spread(spark, f"{sf_dir}/documents.parquet")


def _tidy(df: DataFrame) -> DataFrame:
    """Longs for ints and joined strings for arrays, so that schemas of engines agree."""
    columns = []
    for name, kind in df.dtypes:
        if kind == "int":
            columns.append(F.col(name).cast("long").alias(name))
        elif kind.startswith("array<"):
            columns.append(F.array_join(F.col(name).cast("array<string>"), ",").alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def _over(name: str, body: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _tidy(body(view(_docs(spark, sf_dir), name)))


def _keyed(records: DataFrame) -> DataFrame:
    return records.withColumn("fingerprint", dedup.fingerprint(F.col("title"), F.col("text")))


def _flat_audit(records: DataFrame) -> DataFrame:
    audit = dedup.duplicate_audit(_keyed(records), "fingerprint")
    return audit.withColumn("removed_title", F.col("removed_record.title")).drop("removed_record")


def _mixed(records: DataFrame) -> DataFrame:
    """Every third record under another dynasty, so that duplicates conflict in it too."""
    return records.withColumn("dynasty", F.when(F.col("source_block") % 3 == 0, "xx").otherwise(F.col("dynasty")))


def _split(records: DataFrame) -> DataFrame:
    """Records with their fingerprints, written once, and their splits."""
    return split.group_split(materialize(split.with_keys(records), "keyed"), "body_fingerprint")


def _planted(good: DataFrame) -> DataFrame:
    """Splits with planted faults: some rows in a second split too, some lost, some changed."""
    again = good.where("source_block % 50 = 0").withColumn("split", F.lit("test"))
    changed = good.withColumn("title", F.when(F.col("source_block") % 70 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return changed.where("source_block % 90 <> 0").unionByName(again)


def _broken(records: DataFrame) -> DataFrame:
    return _planted(_split(records))


def _verdicts(records: DataFrame) -> DataFrame:
    """Of the splits as they are made, and with the planted faults."""
    made = _split(records)
    good, bad = split.split_verdict(records, made), split.split_verdict(records, _planted(made))
    return good.withColumn("splits", F.lit("made")).unionByName(bad.withColumn("splits", F.lit("broken")))


def _texts_and_poems(docs: DataFrame) -> DataFrame:
    """Whole texts formatted with the form they are given, and poems with the form found in them."""
    formatted = tokens.format_record(CLASSICAL, F.col("form"), F.col("dynasty"), F.col("author"), F.col("title"), F.col("text")).alias("formatted")
    made = lambda v, kind: v.select("id", F.lit(kind).alias("kind"), formatted)
    return made(view(docs, "v_formed"), "text").unionByName(made(_labelled(view(docs, "v_poems")), "poem"))


def _formatted(records: DataFrame) -> DataFrame:
    return _split(records).withColumn("formatted", tokens.format_record(LATIN_SCRIPT, F.lit(""), F.col("dynasty"), F.col("author"), F.col("title"), F.col("text")))


def _vocab(formatted: DataFrame) -> DataFrame:
    return tokens.build_vocab(formatted.where("split = 'train'"))


def _vocab_summary(records: DataFrame) -> DataFrame:
    formatted = _formatted(records)
    return tokens.vocab_summary(formatted.where("split = 'train'"), _vocab(formatted))


def _encoded(records: DataFrame) -> DataFrame:
    formatted = _formatted(records)
    return tokens.encode(formatted, _vocab(formatted))


def _offsets(records: DataFrame) -> DataFrame:
    formatted = _formatted(records).select("id", "split", "formatted")
    return _placed(formatted, _vocab(formatted))


def _size() -> Column:
    """Ids of a formatted record: its characters and the two specials around them."""
    return F.length("formatted") + 2


def _placed(formatted: DataFrame, vocab: DataFrame) -> DataFrame:
    """Records placed in their streams by their lengths and then encoded, so that no ids are written."""
    placed = tokens.token_offsets(formatted, size=_size(), among="formatted")
    return tokens.encode(placed, vocab).drop("formatted")


def _sampled(records: DataFrame) -> DataFrame:
    formatted = _formatted(records).select("id", "split", "formatted")
    lengths = {r.split: r.n for r in formatted.groupBy("split").agg(F.sum(_size()).alias("n")).collect()}
    return windows.sample_windows(_placed(formatted, _vocab(formatted)), SAMPLES, BLOCK, tokens=lengths)


def _decoded(records: DataFrame) -> DataFrame:
    formatted = _formatted(records)
    vocab = _vocab(formatted)
    return tokens.decode(tokens.encode(formatted, vocab), vocab).select("id", "split", "decoded")


def _digest(df: DataFrame, *columns: str) -> DataFrame:
    """Long lists as digests."""
    for c in columns:
        df = df.withColumn(c, F.sha2(F.array_join(F.col(c).cast("array<string>"), ",").cast("binary"), 256))
    return df


def _labelled(poems: DataFrame) -> DataFrame:
    return poems.withColumn("form", forms.label_form(F.col("text"), CLASSICAL))


def _shape(records: DataFrame) -> DataFrame:
    return records.select("id", clean.clause_shape(LATIN_SCRIPT, F.col("text")).alias("s")).select("id", "s.*")


def _routed(records: DataFrame) -> DataFrame:
    return clean.route_by_quality(records, LATIN_SCRIPT)


def _content(records: DataFrame, policy) -> DataFrame:
    return records.select("id", validate.content_reasons(policy, *(F.col(c) for c in ("title", "dynasty", "author", "text"))).alias("reasons"))


def _key_flags(lines: DataFrame) -> DataFrame:
    keys = materialize(validate.validate_structure(lines).select("line_number", "id", "source_block"), "keys")
    return validate.duplicate_key_flags(keys, LATIN_SCRIPT).select("line_number", "key_reasons")


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    vocab = tokens.build_vocab(docs.select(F.concat("text", F.lit("体裁五言绝句朝代作者题目正文：\n自由诗")).alias("formatted")))
    found = tokens.screen_prompts(view(docs, "v_requests"), vocab, CLASSICAL)
    return _tidy(found.select("request", "prompt", "reasons", "accepted"))


def _unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(_docs(spark, sf_dir), "v_dirty")
    vocab = tokens.build_vocab(_split(docs).where("split = 'train'").select(F.col("text").alias("formatted")))
    return _tidy(tokens.oov_report(docs, vocab).select("id", "unsupported", "accepted"))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latin and classical blocks in one job, each by its own rules."""
    blocks = view(_docs(spark, sf_dir), "v_corpus")
    return _tidy(prepare.funnel(prepare.prepare_corpus(blocks, {"latin": LATIN_SCRIPT, "classical": CLASSICAL}, kind="kind")))


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = view(_docs(spark, sf_dir), "v_dirty")
    routed = _routed(records)
    stages = [(s, routed, routed.where(F.col("status") == s)) for s in ("clean", "review", "quarantine")]
    return _tidy(prepare.stage_funnel(stages))


def _counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def _read_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text written to files, blank lines between them, and read back in blocks."""
    path = new_path(spark, "text")
    view(_docs(spark, sf_dir), "v_spaced").select("text").write.option("lineSep", "\n\n").text(path)
    blocks = text_files.read_text_blocks(spark, path)
    return _counted(blocks.select(F.sha2(F.col("block").cast("binary"), 256).alias("block_sha256")), "block_sha256")


def _read_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with lines that end in CRLF."""
    path = new_path(spark, "text")
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    view(_docs(spark, sf_dir), "v_spaced").select(text.alias("text")).write.option("lineSep", "\r\n\r\n").text(path)
    blocks = text_files.read_mixed_blocks(spark, path)
    return _counted(blocks.select(F.sha2(F.col("block").cast("binary"), 256).alias("block_sha256")), "block_sha256")


def _gated(docs: DataFrame) -> DataFrame:
    """Bytes of the texts, every fifth with one that UTF-8 doesn't have."""
    content = F.when(F.col("source_block") % 5 == 0, F.concat(F.unhex(F.lit("FF")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    gated = text_files.utf8_gate(docs.select("id", content.alias("content")))
    return gated.select("id", "is_utf8", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def _stored_records(spark: SparkSession, sf_dir: str, by: str | None = None) -> str:
    path = new_path(spark, "records")
    record_files.write_records_jsonl(view(_docs(spark, sf_dir), "v_records"), path, by)
    return path


def _read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_files.read_records_jsonl(spark, _stored_records(spark, sf_dir, by="dynasty"))


def _written_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.text(_stored_records(spark, sf_dir))
    return _counted(lines.select(F.sha2(F.col("value").cast("binary"), 256).alias("line_sha256")), "line_sha256")


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = _formatted(view(_docs(spark, sf_dir), "v_records")).select("id", "split", "formatted")
    vocab = materialize(_vocab(formatted), "vocab")
    return _tidy(record_files.write_token_shards(_placed(formatted, vocab), new_path(spark, "shards"), vocab.count(), SHARD_TOKENS))


def _kept_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "vocab")
    record_files.save_vocab(_vocab(_formatted(view(_docs(spark, sf_dir), "v_records"))), path)
    return _tidy(record_files.load_vocab(spark, path))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in files of FILE_RECORDS records each, in order, and what the manifest says of them."""
    path = new_path(spark, "files")
    keyed = view(_docs(spark, sf_dir), "v_records").select("source_block", "text").withColumn("file", F.floor(F.col("source_block") / FILE_RECORDS))
    keyed.repartition("file").sortWithinPartitions("file", "source_block").select("file", "text").write.partitionBy("file").text(path)
    return record_files.artifact_manifest(spark, path).where("path like '%.txt'").select("bytes", "sha256")


def queries() -> dict[str, Query]:
    return {
        "read_text_blocks": _read_blocks,
        "read_mixed_blocks": _read_mixed,
        "utf8_gate": _over("v_records", _gated),
        "read_records_jsonl": _read_records,
        "write_records_jsonl": _written_lines,
        "write_token_shards": _shards,
        "load_vocab": _kept_vocab,
        "artifact_manifest": _manifest,
        "global_index": _over("v_records", lambda v: index.global_index(v.select("source_block", "id"), ["source_block"], "ordinal")),
        "corpus_totals": _over("v_dirty", profile.corpus_totals),
        "field_count_histogram": _over("v_blocks", profile.field_count_histogram),
        "length_stats": _over("v_records", profile.length_stats),
        "category_counts": _over("v_latin_mix", lambda v: profile.category_counts(v, "dynasty")),
        "marker_counts": _over("v_dirty", lambda v: profile.marker_counts(v, LATIN_SCRIPT.profile_markers + CLASSICAL.profile_markers)),
        "longest_records": _over("v_records", profile.longest_records),
        "malformed_examples": _over("v_blocks", profile.malformed_examples),
        "char_frequency": _over("v_dirty", profile.char_frequency),
        "normalize_text": _over("v_raw", lambda v: v.select("doc_id", normalize.normalize_text(F.col("text"), CLASSICAL).alias("text"))),
        "normalization_stats": _over("v_raw", lambda v: normalize.normalization_stats(v, CLASSICAL)),
        "parse_accepted": _over("v_blocks", lambda v: parse.accepted(parse.parse_blocks(v, LATIN_SCRIPT))),
        "parse_rejected": _over("v_blocks", lambda v: parse.rejected(parse.parse_blocks(v, LATIN_SCRIPT))),
        "parse_summary": _over("v_blocks", lambda v: parse.parse_summary(parse.parse_blocks(v, LATIN_SCRIPT))),
        "validate_structure": _over("v_jsonl", lambda v: validate.validate_structure(v).select("line_number", "reasons", "error", "raw_excerpt")),
        "duplicate_key_flags": _over("v_jsonl", _key_flags),
        "content_reasons": _over("v_dirty", lambda v: _content(v, LATIN_SCRIPT)),
        "content_reasons_classical": _over("v_latin_mix", lambda v: _content(v, CLASSICAL)),
        "suspicious_records": _over("v_jsonl", lambda v: validate.suspicious_records(validate.validate(v, LATIN_SCRIPT)).select("line_number", "reasons", "id", "dynasty")),
        "validation_summary": _over("v_jsonl", lambda v: validate.validation_summary(validate.validate(v, LATIN_SCRIPT))),
        "fingerprints": _over("v_records", lambda v: v.select("id", dedup.fingerprint(F.col("title"), F.col("text")).alias("fingerprint"), dedup.body_fingerprint(F.col("text")).alias("body_fingerprint"))),
        "dedup_keep_first": _over("v_records", lambda v: dedup.dedup_keep_first(_keyed(v), "fingerprint")),
        "duplicate_audit": _over("v_records", lambda v: _flat_audit(_mixed(v))),
        "dedup_summary": _over("v_records", lambda v: dedup.dedup_summary(_keyed(_mixed(v)), "fingerprint", dedup.duplicate_audit(_keyed(_mixed(v)), "fingerprint"))),
        "same_body_different_title": _over("v_records", dedup.same_body_different_title),
        "clean_hard_reasons": _over("v_latin_mix", lambda v: v.select("id", clean.hard_reasons(CLASSICAL, *(F.col(c) for c in ("title", "dynasty", "author", "text"))).alias("reasons"))),
        "clean_review_reasons": _over("v_dirty", lambda v: v.select("id", clean.review_reasons(CLASSICAL, F.col("title"), F.col("text"), clean.clause_shape(CLASSICAL, F.col("text"))).alias("reasons"))),
        "clause_shape": _over("v_records", _shape),
        "route_by_quality": _over("v_dirty", lambda v: _routed(v).select("id", "status", "reasons")),
        "reason_counts": _over("v_dirty", lambda v: clean.reason_counts(_routed(v))),
        "group_split": _over("v_records", lambda v: _split(v).select("id", "body_fingerprint", "split")),
        "split_summary": _over("v_records", lambda v: split.split_summary(_split(v), "body_fingerprint")),
        "split_overlaps": _over("v_records", lambda v: split.split_overlaps(_broken(v))),
        "split_accounting": _over("v_records", lambda v: split.split_accounting(v, _broken(v))),
        "split_verdict": _over("v_records", _verdicts),
        "sample_per_group": _over("v_records", lambda v: split.sample_per_group(_split(v), "split", SAMPLE_SIZES).select("id", "split", F.length("text").alias("body_length"))),
        "label_form": _over("v_poems", lambda v: _labelled(v).select("id", "form")),
        "keep_labelled": _over("v_poems", lambda v: forms.keep_labelled(v, CLASSICAL).select("id", "text", "form")),
        "form_counts": _over("v_poems", lambda v: forms.form_counts(forms.keep_labelled(v, CLASSICAL))),
        "verify_form": _over("v_poems", lambda v: forms.verify_form(v, CLASSICAL, form="wanted")),
        "format_record": lambda spark, sf_dir: _tidy(_texts_and_poems(_docs(spark, sf_dir))),
        "build_vocab": _over("v_records", lambda v: _vocab(_formatted(v))),
        "vocab_summary": _over("v_records", _vocab_summary),
        "encode": _over("v_records", lambda v: _digest(_encoded(v).select("id", F.size("tokens").alias("n"), "tokens"), "tokens")),
        "token_summary": _over("v_records", lambda v: tokens.token_summary(_encoded(v))),
        "decode": _over("v_records", _decoded),
        "token_offsets": _over("v_records", lambda v: _offsets(v).select("id", "split", F.size("tokens").alias("n"), "tok_start")),
        "next_token_windows": _over("v_records", lambda v: _digest(windows.next_token_windows(_offsets(v), BLOCK, STRIDE), "x", "y")),
        "sample_windows": _over("v_records", lambda v: _digest(_sampled(v), "x", "y")),
        "oov_report": _unknown,
        "screen_prompts": _screened,
        "stage_funnel": _routes,
        "prepare_corpus": _prepared,
    }
