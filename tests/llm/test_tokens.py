import base64
import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import _bytes as B
from corpusloom.llm import bpe, packing, token_files
from corpusloom.llm._shared import shared_dir
from corpusloom.llm.library_tokens import LibraryTokens
from corpusloom.llm.queries import queries

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tools():
    vocabulary = bpe.Vocabulary.from_ranks(bpe.load_ranks(MULTI))
    library = Tokenizer.from_file(PLAIN)
    library.encode_special_tokens = True
    return vocabulary, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}), library


PIECES = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\r\n", "\t", "a", "Word", "1", "23", "!", "é", "日", "　", "\xa0", "😀", "\x00", "\x1c", "́", "<|endoftext|>"]


def test_encoding_equals_both_libraries(tools):
    vocabulary, reference, library = tools
    rng = random.Random(5)
    texts = ["", "'", "a 's", "'s's", "x" * 3000] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    data, offsets = B.text_buffers(pa.array(texts))
    for a, b, part, off in B.chunks(data, offsets, 5000):
        ids, at = vocabulary.encode(part, off)
        assert vocabulary.decode(ids, at)[0].tobytes() == part.tobytes()
        theirs, their_at = LibraryTokens.of(PLAIN).encode(part, off)
        for k in range(a, b):
            assert ids[at[k - a] : at[k - a + 1]].tolist() == reference.encode_ordinary(texts[k])
            assert theirs[their_at[k - a] : their_at[k - a + 1]].tolist() == library.encode(texts[k], add_special_tokens=False).ids


def test_long_texts_are_encoded_piece_by_piece(tools, monkeypatch):
    vocabulary, reference, library = tools
    rng = random.Random(6)
    texts = ["".join(rng.choice(PIECES) for _ in range(n)) for n in (400, 700, 3000)] + ["x" * 900, "é" * 900, " \n" * 300]
    plain = Tokenizer.from_file(PLAIN)
    monkeypatch.setattr(B, "CHUNK_BYTES", 40)
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        off = np.array([0, len(data)])
        assert B.is_long(off)
        assert vocabulary.encode(data, off)[0].tolist() == reference.encode_ordinary(text)
        tokens = LibraryTokens.of(PLAIN)
        assert tokens.encode(data, off)[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert tokens.encode_added(data, off)[0].tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(texts):
    vocabulary = bpe.Vocabulary.from_ranks({bytes([i]): i for i in range(256)} | {b"th": 256, b"the": 257, b" the": 258, b"aa": 259, b"aaaa": 260})
    reference = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    data, offsets = B.text_buffers(pa.array(texts, pa.string()))
    ids, at = vocabulary.encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [reference.encode_ordinary(t) for t in texts]


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    table = bpe.PerfectHash.build(keys)
    assert sorted(table.slots(keys)) == list(range(len(keys))) and (table.keys[table.slots(keys)] == keys).all()


def test_bpe_query_on_awkward_rows(awkward, empty, tools):
    df, rows = awkward
    _, reference, _ = tools
    want = sorted((str(i), len(e := reference.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r[0]), *r[1:]) for r in bpe.encoding_digests(df, MULTI).collect()) == want
    assert bpe.encoding_digests(empty, MULTI).count() == 0
    clash = bpe.encode_documents(df.withColumnRenamed("lang", "ids"), MULTI)
    assert clash.columns == ["doc_id", "source", "n_chars", "ids"] and clash.count() == len(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_byte_aligned_code_round_trip(values):
    controls, data = token_files.pack(np.array(values, np.int64))
    assert token_files.unpack(controls, data, len(values)).tolist() == values
    assert len(controls) == -(-len(values) // 4)


def test_token_files_on_awkward_rows(spark, awkward, empty, tools, tmp_path):
    df, rows = awkward
    *_, library = tools
    shared_dir(spark)
    path = str(tmp_path / "files")
    ranks = token_files.write_token_files(df, path, PLAIN)
    assert ranks.orderBy("rank").first().n == max(r.n for r in ranks.collect())
    got = sorted(token_files.file_digests(spark, path).collect(), key=lambda r: r.start)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert list(map(tuple, got)) == want
    token_files.write_token_files(empty, str(tmp_path / "none"), PLAIN)
    assert token_files.file_digests(spark, str(tmp_path / "none")).count() == 0


def test_packing_on_awkward_rows(awkward, empty, tools):
    df, rows = awkward
    *_, library = tools
    got = packing.pack_documents(df, PLAIN).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and {r.offset for r in got} == {0}
    by_id = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in by_id] == sorted((r.length for r in got), reverse=True)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for n in packing.piece_lengths(len(ids)):
            want.append((str(i), at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    assert packing.pack_documents(empty, PLAIN).count() == 0


def test_rank_file_is_read():
    ranks = bpe.load_ranks(MULTI)
    assert len(ranks) == 50_256 and base64.b64encode(next(iter(ranks)))


def test_added_tokens_as_the_library_finds_them():
    library, rng = Tokenizer.from_file(PLAIN), random.Random(8)
    pieces = [*PIECES, "<|endoftext|>", "<|endof", "text|>", "<|"]
    texts = ["a <|endoftext|> b", "<|endof", "text|>", "", "<|endoftext|>"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    data, offsets = B.text_buffers(pa.array(texts))
    for a, b, part, off in B.chunks(data, offsets, 5000):
        ids, at = LibraryTokens.of(PLAIN).encode_added(part, off)
        assert [ids[at[k - a] : at[k - a + 1]].tolist() for k in range(a, b)] == [library.encode(texts[k], add_special_tokens=False).ids for k in range(a, b)]


def test_queries_give_added_tokens_their_ids(spark, tmp_path):
    library, texts = Tokenizer.from_file(PLAIN), ["a <|endoftext|> b", "plain", "<|endoftext|>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    crc = lambda k, end: zlib.crc32(np.array(ids[k] + [end], "<u4").tobytes())
    files = sorted(map(tuple, queries()["op5_token_files"](spark, str(tmp_path)).collect()))
    starts = np.cumsum([0] + [len(i) + 1 for i in ids]).tolist()
    assert files == [(k, starts[k], len(ids[k]) + 1, crc(k, 2)) for k in range(3)]
    packed = {r.doc_id: r.doc_tokens for r in queries()["op9_packing"](spark, str(tmp_path)).collect()}
    assert packed == {k: len(i) + 1 for k, i in enumerate(ids)}
    last = corpus_pipeline.packing(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id: r.doc_tokens for r in last.collect()} == packed
