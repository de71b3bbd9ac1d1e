"""Windows, shards, vocabularies and plans: whole results at any size of what is taken together."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index, normalize, split, tokens, validate, windows
from corpusloom.plans import queries as plans
from corpusloom.policy import CLASSICAL, LATIN_SCRIPT, by_kind
from corpusloom.sources import records, text


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def streams(seed=1):
    """Rows (split, tokens, tok_start), some empty, null or longer than a stretch, and each split's whole stream."""
    rng, rows, whole = random.Random(seed), [], {}
    for name in ("train", "test", "validation"):
        whole[name] = []
        for _ in range({"train": 60, "test": 7, "validation": 1}[name]):
            ids = [rng.randrange(3, 60_000) for _ in range(rng.choice([0, 1, 5, 40, 300]))]
            rows.append((name, ids or rng.choice([[], None]), len(whole[name])))
            whole[name] += ids
    return rows, whole


def encoded(spark, rows):
    return spark.createDataFrame(rows, "split string, tokens array<int>, tok_start long").repartition(5)


@pytest.mark.parametrize("block,stride,stretch", [(8, 8, 1 << 16), (8, 3, 32), (16, 64, 64), (5, 1, 7), (400, 10, 100)])
def test_windows_are_those_of_the_stream(spark, block, stride, stretch, monkeypatch):
    monkeypatch.setattr(windows, "STRETCH_TOKENS", stretch)
    rows, whole = streams()
    got = sorted((r.split, r.start, r.x, r.y) for r in windows.next_token_windows(encoded(spark, rows), block, stride).collect())
    assert got == sorted((k, s, v[s : s + block], v[s + 1 : s + block + 1]) for k, v in whole.items() for s in range(0, len(v) - block, stride))


def test_samples_are_cut_where_they_were_drawn(spark):
    rows, whole = streams(2)
    got = windows.sample_windows(encoded(spark, rows), 40, 16).collect()
    assert {(r.sample, r.split) for r in got} == {(i, k) for k, v in whole.items() if len(v) > 17 for i in range(40)} and len(got) == len({(r.sample, r.split) for r in got})
    for r in got:
        digits = hashlib.sha256(f"42:{r.split}:{r.sample}".encode()).hexdigest()[:15]
        v = whole[r.split]
        assert r.start == int(digits, 16) % (len(v) - 17) and r.x == v[r.start : r.start + 16] and r.y == v[r.start + 1 : r.start + 17]


@pytest.mark.parametrize("shard,chunk", [(100, 1 << 20), (1000, 64), (1 << 24, 10)])
def test_shards_are_the_stream_in_bounded_rows(spark, tmp_path, shard, chunk):
    rows, whole = streams(3)
    meta = records.write_token_shards(encoded(spark, rows), str(tmp_path / "s"), 60_000, shard, chunk)
    stored = sorted(spark.read.parquet(str(tmp_path / "s")).collect(), key=lambda r: (r.split, r.shard, r.chunk))
    assert max(len(r.packed) for r in stored) <= chunk
    assert [r.chunk for r in stored if (r.split, r.shard) == ("train", 0)] == list(range(sum((r.split, r.shard) == ("train", 0) for r in stored)))
    for name, ids in whole.items():
        assert b"".join(r.packed for r in stored if r.split == name) == np.array(ids, "<u2").tobytes()
    for m in meta.collect():
        own = b"".join(r.packed for r in stored if (r.split, r.shard) == (m.split, m.shard))
        starting = [r for r in rows if r[0] == m.split and r[2] // shard == m.shard]
        assert (m.sha256, m.bytes, m.n_tokens) == (hashlib.sha256(own).hexdigest(), len(own), len(own) // 2)
        assert (m.records, m.unknown_tokens) == (len(starting), sum((t or []).count(3) for _, t, _ in starting))


def test_encoding_and_unknown_characters(spark):
    vocab = tokens.build_vocab(spark.createDataFrame([("abé床😀\n",)], "formatted string"))
    rows = [(1, "abx😀"), (2, ""), (3, None), (4, "yx\ny"), (5, "床" * 5000 + "Z")]
    df = spark.createDataFrame(rows, "i int, text string")
    places = {r.token: r.id for r in vocab.collect()}
    for bos, eos in ((True, True), (False, True), (True, False), (False, False)):
        got = {r.i: r.tokens for r in tokens.encode(df, vocab, "text", bos=bos, eos=eos).collect()}
        assert got == {i: [1] * bos + [places.get(c, 3) for c in t or ""] + [2] * eos for i, t in rows}
    found = {r.i: r.unsupported for r in tokens.oov_report(df, vocab).collect()}
    assert found == {1: ["x"], 2: [], 3: None, 4: ["x", "y"], 5: ["Z"]}


def test_placing_before_encoding_gives_the_same_streams(spark):
    rows = [(f"k{i % 30}", "train" if i % 4 else "test", "ab" * (i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, split string, formatted string")
    vocab = tokens.build_vocab(df)
    late = tokens.token_offsets(tokens.encode(df, vocab))
    early = tokens.encode(tokens.token_offsets(df, size=F.length("formatted") + 2, among="formatted"), vocab)
    rows_of = lambda d: sorted((r.id, r.split, r.tok_start, r.tokens) for r in d.collect())
    assert rows_of(late) == rows_of(early)


def test_ordinals_of_any_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "é"]), rng.choice([None, *range(20)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, n int, i int").repartition(6)
    got = sorted(index.global_index(df, ["k", "n", "i"], "at").collect(), key=lambda r: r["at"])
    key = lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])
    assert [r["at"] for r in got] == list(range(1, 501)) and [tuple(r)[:3] for r in got] == sorted(rows, key=key)
    sums = sorted(index.prefix_sum(df, ["n", "i"], F.col("i"), "before", by=["k"]).collect(), key=lambda r: key(tuple(r)))
    total = {}
    for r in sums:
        assert r.before == total.get(r.k, 0)
        total[r.k] = total.get(r.k, 0) + r.i
    assert index.global_index(df.where("false"), ["k"], "at").count() == 0


def test_blocks_are_numbered_without_a_sort(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    blocks = text.read_text_blocks(spark, str(tmp_path))
    assert not [line for line in plan(blocks).splitlines() if "Sort" in line and " block#" in line]


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([(1, '{"id":"poem-0000001"}'), (2, "x")], "line_number long, value string")
    assert plan(validate.validate_structure(lines)).count("ParseJson") + plan(validate.validate_structure(lines)).lower().count("parse_json(") <= 2


def test_overlaps_of_all_keys_take_one_scan(spark, tmp_path):
    rows = [(f"i{i % 40}", f"b{i % 33}", i % 50, ["train", "test", "validation"][i % 3]) for i in range(90)] + [(None, None, None, "train"), (None, None, None, "test")]
    spark.createDataFrame(rows, "id string, body_fingerprint string, source_block int, split string").write.parquet(str(tmp_path / "s"))
    found = split.split_overlaps(spark.read.parquet(str(tmp_path / "s")))
    assert plan(found).count("FileScan") == 1
    want = {}
    for k, key in enumerate(("id", "body_fingerprint", "source_block")):
        by = {s: {r[k] for r in rows if r[3] == s and r[k] is not None} for s in split.SPLITS}
        want |= {(key, f"{a}/{b}"): len(by[a] & by[b]) for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))}
    assert {(r.key, r.pair): r.shared for r in found.collect()} == want
    assert {r.shared for r in split.split_overlaps(spark.read.parquet(str(tmp_path / "s")).where("false")).collect()} == {0}


def test_each_kind_has_its_own_policy(spark):
    rows = [(1, "latin", "a．b"), (2, "classical", "a．b")]
    df = spark.createDataFrame(rows, "i int, kind string, text string")
    own = {"latin": LATIN_SCRIPT, "classical": CLASSICAL}
    cut = df.select("i", by_kind(own, F.col("kind"), lambda p: F.lit(p.name)).alias("name"), normalize.normalize_text(F.col("text"), own, F.col("kind")).alias("text"))
    assert {r.i: (r.name, r.text) for r in cut.collect()} == {1: ("latin", "a。b"), 2: ("classical", "a。b")}
    with pytest.raises(Exception, match="no policy for other"):
        df.withColumn("kind", F.lit("other")).select(by_kind(own, F.col("kind"), lambda p: F.lit(p.name))).collect()


def test_names_with_dots_and_backticks(spark):
    df = spark.createDataFrame([("poem-0000001", 1, "t", "x", 5), ("poem-0000001", 2, "t", "x", 5)], "id string, source_block long, title string, `a.b` string, `c``d` int")
    flags = validate.duplicate_key_flags(df.withColumn("line_number", F.col("source_block")), LATIN_SCRIPT)
    assert {"a.b", "c`d"} <= set(flags.columns) and sorted(r.key_reasons for r in flags.collect()) == [[], ["duplicate_id"]]
    assert {"a.b", "c`d"} <= set(normalize.separated_blocks(df, "title").columns)


def test_the_whole_preparation_labels_forms(spark):
    rows = {r.stage: (r.rows_in, r.rows_out) for r in plans.queries()["prepare_corpus"](spark, "/root/testdata/sf0.001").collect()}
    assert 0 < rows["label"][1] < rows["label"][0]
