"""Files in and out, and the stateless steps on a stream."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import tokens
from corpusloom.policy import CLASSICAL
from corpusloom.sources import records, shared, text
from corpusloom.streaming import route


@pytest.mark.parametrize("size", ["128m", "64"])
def test_blocks_are_numbered_over_split_borders(spark, tmp_path, size):
    raw = "".join(f"题{i}\n唐朝]\n\t\n床{'前' * (i % 9)}\n\n" + " \n\n" * (i % 2) for i in range(60))
    (tmp_path / "a.txt").write_text(raw + "last\n")
    (tmp_path / "b.txt").write_text("one\n\n\ntwo")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    found = text.read_text_blocks(spark, str(tmp_path)).orderBy("block_number").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [b for f in (raw + "last\n", "one\n\n\ntwo") for b in f.split("\n\n") if b.strip()]
    assert [r.block for r in found] == want and [r.block_number for r in found] == list(range(1, len(want) + 1))


def test_mixed_line_ends(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("a\r\nb\r\n\r\nc\rd\r\re".encode())
    assert [r.block for r in text.read_mixed_blocks(spark, str(tmp_path)).orderBy("block_number").collect()] == ["a\nb", "c\nd", "e"]


@pytest.mark.parametrize("size", ["128m", "16"])
def test_mixed_blocks_are_those_of_the_whole_text(spark, tmp_path, size):
    rng = random.Random(size)
    raws = ["".join(rng.choice(["\n", "\r\n", "\n\n", "\n\n\n", "\r", "a", "b ", " ", "\u3000", "cd"]) for _ in range(120)) + "end" for _ in range(3)] + ["\n\n\nx", "\ny"]
    for i, raw in enumerate(raws):
        (tmp_path / f"{i}.txt").write_bytes(raw.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    found = text.read_mixed_blocks(spark, str(tmp_path)).orderBy("block_number").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plain = [re.sub("\r\n?", "\n", raw) for raw in raws]
    want = [b for p in plain for b in p.split("\n\n") if b.strip()]
    assert [r.block for r in found] == want and [r.block_number for r in found] == list(range(1, len(want) + 1))


def test_no_folder_of_one_machine_on_a_cluster(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster())
    assert shared.shared_dir(spark) == shared.shared_dir(spark)


def test_utf8_gate(spark):
    df = spark.createDataFrame([(1, bytearray("é".encode())), (2, bytearray(b"\xff\xfe"))], "i int, content binary")
    assert {r.i: (r.text, r.is_utf8) for r in text.utf8_gate(df).collect()} == {1: ("é", True), 2: (None, False)}
    with pytest.raises(Exception, match="UTF"):
        text.utf8_gate(df, strict=True).select("text").collect()


def test_records_round_trip(spark, tmp_path):
    rows = [("poem-0000001", "题", "唐朝", "", "床\n前 ", 1), ("poem-0000002", "t", "清朝", None, "x", 2)]
    df = spark.createDataFrame(rows, records.RECORD)
    records.write_records_jsonl(df, str(tmp_path / "all"))
    assert sorted(map(tuple, records.read_records_jsonl(spark, str(tmp_path / "all")).collect())) == rows
    records.write_records_jsonl(df, str(tmp_path / "by"), by="dynasty")
    assert records.read_records_jsonl(spark, str(tmp_path / "by")).count() == 2
    (tmp_path / "bad.json").write_text("[1\n")
    with pytest.raises(Exception):
        records.read_records_jsonl(spark, str(tmp_path / "bad.json")).collect()


def test_vocab_shards_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", "床前明月"), ("b", "train", "光光"), ("c", "test", "？")], "id string, split string, formatted string")
    vocab = tokens.build_vocab(df.where("split = 'train'"))
    records.save_vocab(vocab, str(tmp_path / "vocab"))
    vocab = records.load_vocab(spark, str(tmp_path / "vocab"))
    placed = tokens.token_offsets(tokens.encode(df, vocab))
    meta = {r.split: r for r in records.write_token_shards(placed, str(tmp_path / "shards"), vocab.count()).collect()}
    assert meta["train"].bytes == 2 * meta["train"].n_tokens == 2 * 10 and meta["train"].unknown_tokens == 0 and meta["test"].unknown_tokens == 1
    with pytest.raises(ValueError):
        records.write_token_shards(placed, str(tmp_path / "no"), 70_000)
    with pytest.raises(ValueError):
        records.check_vocab(vocab.withColumn("id", F.lit(0)))
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.bin").write_bytes(b"abc")
    row = records.artifact_manifest(spark, str(tmp_path / "files")).first()
    assert (row.bytes, row.sha256) == (3, hashlib.sha256(b"abc").hexdigest())


def test_route_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"题{i}\n唐朝]\n佚名\n" + ("床前明月光，疑是地上霜。" if i % 2 else "see https://a.example now")) for i in range(20)]
    df = spark.createDataFrame(rows, "block_number long, block string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = route.write_stream(route.route_stream(stream, CLASSICAL), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    batch = route.route_stream(df, CLASSICAL)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(batch.columns).collect())) == sorted(map(str, batch.collect()))
