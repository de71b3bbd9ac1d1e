import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import best_fit

PATH = public_tokenizers.path("byte_bpe_50k.json")


def bins_of(lengths, full):
    return max(best_fit.best_fit(sorted(lengths, reverse=True), full), default=-1) + 1


def counts_of(lengths, full):
    return np.bincount(np.array(lengths, np.int64), minlength=full + 1)


@cache
def optimum(lengths, full):
    """The least number of bins, by trying all subsets that hold the first length."""
    if not lengths:
        return 0
    best = len(lengths)
    head, rest = lengths[0], lengths[1:]
    for mask in range(1 << len(rest)):
        if head + sum(x for k, x in enumerate(rest) if mask >> k & 1) <= full:
            best = min(best, 1 + optimum(tuple(x for k, x in enumerate(rest) if not mask >> k & 1), full))
    return best


def test_bound_optimum_and_best_fit():
    rng = random.Random(4)
    tight = 0
    for _ in range(300):
        full = rng.choice([10, 16, 60])
        lengths = tuple(sorted((rng.randint(1, full) for _ in range(rng.randint(0, 8))), reverse=True))
        low, best, used = best_fit.lower_bound(counts_of(lengths, full)), optimum(lengths, full), bins_of(lengths, full)
        assert -(-sum(lengths) // full) <= low <= best <= used
        tight += low == used
    assert tight > 250


def test_functions_beyond_the_sum():
    """Halves, thirds and mixtures where the sum alone certifies nothing."""
    for lengths in ([1025] * 9, [700] * 10, [1400] * 4 + [700] * 3):
        assert best_fit.lower_bound(counts_of(lengths, 2048)) == bins_of(lengths, 2048) > -(-sum(lengths) // 2048)


def test_best_fit_takes_the_fullest_bin():
    assert best_fit.best_fit([7, 6, 4, 3], 10) == [0, 1, 1, 0]


def expected(rows, end_id):
    library = Tokenizer.from_file(PATH)
    out = {}
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end_id]
        lengths, start, pieces = best_fit.piece_lengths(len(ids)), 0, []
        for piece, length in enumerate(lengths):
            pieces.append((piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
            start += length
        assert start == len(ids) and lengths[1:] == [2048] * (len(lengths) - 1) and 0 < lengths[0] <= 2048
        out.setdefault(doc_id, []).append(pieces)
    return out


def check(rows, got, end_id=0):
    want = [(doc_id, *p) for doc_id, copies in expected(rows, end_id).items() for pieces in copies for p in pieces]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_awkward_rows(spark, awkward, empty):
    df, rows = awkward
    df = df.selectExpr("*", "1 as length", "2 as own", "3 as bin", "4 as `a.b`")
    sequences = check(rows, best_fit.pack_best_fit(df, PATH, added=True).collect())
    total = sum(p[2] for copies in expected(rows, 0).values() for pieces in copies for p in pieces)
    assert sequences == -(-total // 2048)
    assert best_fit.pack_best_fit(empty, PATH).count() == 0


@pytest.mark.parametrize("pieces", [40, 1 << 13])
def test_partitions_exchange(spark, pieces, monkeypatch):
    """Small partitions leave gaps of their own; exchange closes them to near the bound of the whole table."""
    monkeypatch.setattr(best_fit, "PARTITION_PIECES", pieces)
    rng = random.Random(9)
    rows = [(i, "a b " * rng.randint(1, 500)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = best_fit.pack_best_fit(df, PATH, with_ids=True).collect()
    counts = counts_of([r.length for r in got if r.length < 2048], 2048)
    assert check(rows, got) <= 1.01 * best_fit.lower_bound(counts) + sum(r.length == 2048 for r in got)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
