"""Hand-written rows for each place where string semantics differ between engines."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import unicode_classes as U
from corpusloom.operators import clean, dedup, forms, index, normalize, parse, split, tokens, validate, windows
from corpusloom.operators.normalize import normalize_text
from corpusloom.policy import CLASSICAL


def held(ranges):
    return {c for a, b in U.parse_ranges(ranges) for c in range(a, b + 1)}


def test_classes_equal_the_unicode_database():
    everything = range(0x110000)
    name = lambda c: unicodedata.name(chr(c), "")
    assert held(U.WS_RANGES) == {c for c in everything if chr(c).isspace()}
    assert held(U.LATIN_RANGES) == {c for c in everything if unicodedata.category(chr(c))[0] == "L" and "LATIN" in name(c)}
    assert held(U.HAN_RANGES) == {c for c in everything if "CJK UNIFIED IDEOGRAPH" in name(c) or "CJK COMPATIBILITY IDEOGRAPH" in name(c)}
    assert held(U.CONTROL_RANGES) == {c for c in everything if unicodedata.category(chr(c)) == "Cc" and chr(c) not in "\n\r\t"}


TEXTS = ["", " ", "　a　", "\x1ca\x85", "a b\r\nc\rd\x1e", "a\n", "\n", "a\n\n", "ªKʰＡ〇々", "x\x0by\x0c", "𠀀a𝒜", " \t\n\r"]


def values(spark, expr):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_strip_lines_and_characters(spark):
    assert values(spark, T.strip) == [t.strip() for t in TEXTS]
    assert values(spark, T.compact) == ["".join(t.split()) for t in TEXTS]
    assert values(spark, T.physical_lines) == [t.splitlines() for t in TEXTS]
    assert values(spark, T.field_lines) == [[x.strip() for x in t.splitlines() if x.strip()] for t in TEXTS]
    assert values(spark, T.characters) == [list(t) for t in TEXTS]
    assert values(spark, T.latin_count) == [sum(unicodedata.category(c)[0] == "L" and "LATIN" in unicodedata.name(c, "") for c in t) for t in TEXTS]


def test_normalisation_follows_its_steps(spark):
    texts = ["a\r\nb\rc", "é﹐ ", "  a \n \n\n\n\nb﻿\x00", "\n\n", "﻿", "x．y\n　\nz"]

    def plain(t):
        t = unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n")).replace("﻿", "").replace("\x00", "").translate(str.maketrans(CLASSICAL.punctuation))
        t = "\n".join(x if x and not x.strip() else x.strip() for x in t.split("\n"))
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.v for r in df.select("i", normalize_text(F.col("t"), CLASSICAL).alias("v")).orderBy("i").collect()] == [plain(t) for t in texts]
    stats = {r.statistic: r.n for r in normalize.normalization_stats(df.withColumnRenamed("t", "text"), CLASSICAL).collect()}
    assert (stats["crlf"], stats["bare_cr"], stats["bom"], stats["nul"]) == (1, 1, 2, 1)


def test_parse_keeps_blank_author_lines_and_drops_one_bracket(spark):
    blocks = [(1, "t\nd]\na\nb"), (2, "t\nd]]\n \nb"), (3, "t\nd\na"), (4, " \nd]\na\n "), (12345678, "t\nd]\na\nb\n")]
    parsed = parse.parse_blocks(spark.createDataFrame(blocks, "block_number long, block string"), CLASSICAL)
    good = {r.source_block: r for r in parse.accepted(parsed).collect()}
    assert (good[1].id, good[2].dynasty, good[2].author, good[12345678].id) == ("poem-0000001", "d]", "", "poem-12345678")
    assert {r.source_block: r.reason for r in parse.rejected(parsed).collect()} == {3: "physical_line_count_not_4", 4: "empty_title,empty_body"}


def test_json_types(spark):
    base = '{"id":"poem-0000001","title":"t","dynasty":"d","author":"a","text":"x","source_block":%s}'
    lines = [base % "1", base % "true", base % "1.0", base % "null", base % '"1"', "[1]", "{", base % "NaN", '{"id":"a","id":"b"}', base % "1"]
    checked = validate.validate(spark.createDataFrame(list(enumerate(lines, 1)), "line_number long, value string"), CLASSICAL)
    got = {r.line_number: r.reasons for r in checked.collect()}
    assert "wrong_type:source_block" not in got[1] + got[2]
    assert [got[i] for i in (3, 4, 5)] == [["wrong_type:source_block"]] * 3
    assert got[6] == ["record_not_object"] and [got[i] for i in (7, 8, 9)] == [["invalid_json"]] * 3
    assert "duplicate_id" in got[10] and "duplicate_source_block" in got[10] and "duplicate_id" not in got[1]
    with pytest.raises(ValueError):
        validate.assert_blocking(validate.validation_summary(checked))


def test_length_flags(spark):
    lengths = [7, 8, 500, 501, 1000, 1001, 5000, 5001]
    df = spark.createDataFrame([(n, "床" * n) for n in lengths], "n int, text string").withColumns({"title": F.lit("题"), "dynasty": F.lit("唐朝"), "author": F.lit("佚名")})
    cols = [F.col(c) for c in ("title", "dynasty", "author", "text")]
    added = {r.n: r.v for r in df.select("n", validate.content_reasons(CLASSICAL, *cols).alias("v")).collect()}
    assert added[5001] == ["body_longer_than_500", "body_longer_than_1000", "body_longer_than_5000"] and added[8] == added[500] == []
    routed = {r.n: (r.status, r.reasons) for r in clean.route_by_quality(df, CLASSICAL).collect()}
    assert routed[7] == ("quarantine", ["body_shorter_than_8"]) and routed[1000] == ("clean", [])
    assert routed[1001] == routed[5000] == ("review", ["body_longer_than_1000"]) and routed[5001] == ("quarantine", ["body_longer_than_5000"])


def test_markers_inside_markers(spark):
    df = spark.createDataFrame([("题", "唐朝", "佚名", "床前明月光白话译文，", "曰：")], "title string, dynasty string, author string, text string, x string")
    assert clean.route_by_quality(df, CLASSICAL).first().reasons == ["contains_marker:白话译文", "contains_marker:译文"]


def test_forms(spark):
    line = "床前明月光，疑是地上霜。"
    cases = [(line * 2, "五言绝句"), (line * 4, "五言律诗"), (line * 2 + "\n", None), ("床前明月光。疑是地上霜。" * 2, None), (line * 3, None), ("床前明月〇，疑是地上霜。" * 2, None), ("床前明月𠀀，疑是地上霜！" * 2, "五言绝句"), ("", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r.f for r in df.select("i", forms.label_form(F.col("t"), CLASSICAL).alias("f")).orderBy("i").collect()] == [f for _, f in cases]


@pytest.mark.parametrize("partitions", [1, 2, 8])
def test_numbering_and_sums_do_not_depend_on_partitions(spark, partitions):
    rows = [(i * 7 % 1000, i % 13) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, n int").repartition(partitions)
    assert [(r.k, r.o) for r in index.global_index(df, ["k"], "o").orderBy("k").collect()] == [(k, k + 1) for k in range(1000)]
    want, total = {}, 0
    for k, n in sorted(rows):
        want[k] = total
        total += n
    assert {r.k: r.s for r in index.prefix_sum(df, ["k"], F.col("n"), "s").collect()} == want
    assert index.global_index(df.where("k < 0"), ["k"], "o").count() == 0


def test_dedup_and_split_invariants(spark):
    rows = [(f"poem-{i:07d}", f"t{i % 40} ", "唐朝", f"a{i % 3}", f"床前 明月{i % 40}", i) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "id string, title string, dynasty string, author string, text string, source_block long")
    keyed = df.withColumn("fp", dedup.fingerprint(F.col("title"), F.col("text")))
    kept, audit = dedup.dedup_keep_first(keyed, "fp"), dedup.duplicate_audit(keyed, "fp")
    assert kept.count() + audit.count() == 200 and {r.source_block for r in kept.collect()} == set(range(1, 41))
    assert all((r.metadata_conflicts == ["author"]) == ((r.removed_source_block - r.kept_source_block) % 3 != 0) for r in audit.collect())
    for method in ("exact", "hash"):
        done = split.group_split(split.with_keys(df), "body_fingerprint", method=method)
        assert done.count() == 200
        split.assert_split_integrity(df, done)
    counts = {r.split: r.n for r in split.group_split(split.with_keys(df), "body_fingerprint").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(counts["train"] - 180) < 5
    bad = done.unionByName(done.limit(1).withColumn("split", F.when(F.col("split") == "train", "test").otherwise("train")))
    with pytest.raises(ValueError):
        split.assert_split_integrity(df, bad)


def test_tokens_round_trip_and_windows(spark):
    texts = ["床前明月光", "", "a𠀀b", None, "x" * 40, "明月"]
    df = spark.createDataFrame([(f"r{i}", "train" if i != 5 else "test", t) for i, t in enumerate(texts)], "id string, split string, formatted string")
    vocab = tokens.build_vocab(df.where("split = 'train' and id <> 'r2'")).cache()
    encoded = tokens.encode(df, vocab)
    by_join = {r.id: r.tokens for r in tokens.encode_by_join(df.where("formatted <> ''"), vocab).collect()}
    got = {r.id: r.tokens for r in encoded.collect()}
    assert {k: got[k] for k in by_join} == by_join and got["r1"] == got["r3"] == [1, 2]
    shown = {r.id: r.decoded for r in tokens.decode(encoded, vocab).collect()}
    assert shown["r0"] == texts[0] and shown["r2"] == "" and shown["r4"] == texts[4]
    placed = tokens.token_offsets(encoded).cache()
    streams = {}
    for r in sorted(placed.collect(), key=lambda r: r.tok_start):
        assert r.tok_start == len(streams.setdefault(r.split, []))
        streams[r.split] += r.tokens
    for block, stride in ((8, 8), (5, 2), (50, 3)):
        found = {(r.split, r.start): (r.x, r.y) for r in windows.next_token_windows(placed, block, stride).collect()}
        assert found == {(k, s): (v[s : s + block], v[s + 1 : s + block + 1]) for k, v in streams.items() for s in range(0, len(v) - block, stride)}
    drawn = windows.sample_windows(placed, 20, 6).collect()
    assert drawn and all((r.x, r.y) == (streams[r.split][r.start : r.start + 6], streams[r.split][r.start + 1 : r.start + 7]) for r in drawn)
