"""Python workers take little memory and give it back, as an executor has room for a few of them only."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
from conftest_llm import words

from corpusloom.llm import _bytes as B
from corpusloom.llm import library_tokens, packing, repeats, token_files
from corpusloom.llm._shared import frugal


def batch() -> pa.RecordBatch:
    rng = random.Random(1)
    texts = [words(rng, 300) for _ in range(1500)]
    ids = pa.array(range(len(texts)), pa.int64())
    assert sum(map(len, texts)) > 2 << 20
    return pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["did", "th", "text"])


def peak_mb(run, given: pa.RecordBatch) -> float:
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([given]))) > 0
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_runs_take_little_memory():
    got = peak_mb(repeats._runs("bytes", 400), batch())
    assert got < 60, got


def test_pieces_take_little_memory(monkeypatch):
    monkeypatch.setattr(packing.TaskContext, "get", staticmethod(lambda: type("task", (), {"partitionId": staticmethod(lambda: 0)})))
    path = public_tokenizers.path("byte_bpe_50k.json")
    given = batch().select(["did", "text"])
    packing.LibraryTokens.of(path)
    got = peak_mb(packing._pieces(path, 1, 2048, True, True), given)
    assert got < 60, got


def test_token_blocks_take_little_memory(monkeypatch):
    monkeypatch.setattr(token_files.TaskContext, "get", staticmethod(lambda: type("task", (), {"partitionId": staticmethod(lambda: 0)})))
    monkeypatch.setattr(library_tokens.LibraryTokens, "_open", {})
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = type("docs", (), {"mapInArrow": staticmethod(lambda run, schema: run)})
    tokens = library_tokens.LibraryTokens.of(path)
    got = peak_mb(token_files._token_blocks(docs, path, 2, True), batch().select(["did", "text"]))
    assert got < 60, got
    held = sum(a.nbytes for a in (tokens.keys, tokens.begin, tokens.size, tokens.flat))
    assert len(tokens.keys) > 100_000 and held < 60 * len(tokens.keys), (held, len(tokens.keys))


def test_forgotten_pretokens_are_learned_again(monkeypatch):
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    monkeypatch.setattr(library_tokens, "REMEMBERED", 40)
    tokens = library_tokens.LibraryTokens(path)
    for k in range(200):
        texts = [words(rng, rng.randint(0, 12)) for _ in range(5)] + ["the same words", "", "x" * 400]
        ids, at = tokens.encode(*B.text_buffers(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in tokens.library.encode_batch(texts, add_special_tokens=False)], k
        assert (tokens.keys[1:] > tokens.keys[:-1]).all() and len(tokens.keys) < 40 + 110


def test_arrow_memory_is_given_back(monkeypatch):
    given, called = batch(), []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("pool", (), {"release_unused": staticmethod(lambda: called.append(1))}))
    assert list(frugal(lambda batches: batches)(iter([given, given]))) == [given, given]
    assert len(called) == 3
