import math
from fractions import Fraction

import numpy as np
import pytest
from compare import SF, same

from corpusloom.llm import top_k
from corpusloom.llm.oracles import oracle_sql
from corpusloom.llm.queries import queries


def brute(rows, k):
    good = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    m = np.array([np.pad(v, (0, width - len(v))) for _, v in good])
    out = []
    for a, (i, _) in enumerate(good):
        if i is not None and i % 20 == 0:
            score = m @ m[a]
            order = sorted((b for b in range(len(good)) if b != a), key=lambda b: (-score[b], good[b][0] is None, good[b][0]))[:k]
            out += [(i, rank, good[b][0], int(score[b])) for rank, b in enumerate(order, 1)]
    return out


@pytest.mark.parametrize("blocks", [(2048, 512, 64), (16, 4, 2)])
def test_equals_brute_force(spark, blocks, monkeypatch):
    for name, value in zip(("BLOCK", "QUERY_BLOCK", "SLICE_BLOCKS"), blocks):
        monkeypatch.setattr(top_k, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=24) * rng.choice([0.1, 1, 3])]) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)] + [(400, None), (420, [float("nan")] * 24), (440, [None] + [1.0] * 23), (460, [float("inf")] * 24), (None, rows[0][1]), (480, [0.5] * 10), (500, []), (60, rows[60][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(7)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, top_k.top_k(df, k=20).collect()), key=str) == sorted(brute(rows, 20), key=str)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, top_k.top_k(df).collect())) == [(0, 1, 1, 64 * 128)]
    assert top_k.top_k(df.where("false")).count() == 0 and top_k.top_k(df.where("vec_id = 1")).count() == 0


def test_query_matches_sql(spark):
    same(spark, SF, queries()["op8_exact_top_k"], oracle_sql()["op8_exact_top_k"])


def exact(rows, k):
    """The same in Python's integers; products end at the limits of a long."""
    good = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows if all(math.isfinite(x) and math.isfinite(64 * x) for x in v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i % 20 == 0:
            scored = [(max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), j) for b, (j, w) in enumerate(good) if b != a]
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return out


@pytest.mark.parametrize("size", [3.5e5, 1.2e7, 3.5e7, 1e9, 1e17, 1e200, 1e308])
def test_large_components_are_exact(spark, size, monkeypatch):
    """Beyond what doubles, and then longs, hold; beyond a long products count as its limits."""
    monkeypatch.setattr(top_k, "BLOCK", 16)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(int(math.log10(size)))
    rows = [(i, [float(x) * size for x in rng.uniform(-1, 1, 3)]) for i in range(0, 120)]
    rows += [(i, [float(x) for x in rng.uniform(-3, 3, 3)]) for i in range(120, 200)] + [(220, [size, 1.0, 0.0]), (221, [size, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, top_k.top_k(df, k=5).collect())) == sorted(exact(rows, 5))


def test_short_vectors_are_not_sent_to_queries_that_long_ones_satisfy(spark, monkeypatch):
    """With skewed lengths, five times the rows make about five times the blocks that meet, not twenty-five."""
    monkeypatch.setattr(top_k, "BLOCK", 64)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 64)
    met = []
    whole = top_k.meetings
    monkeypatch.setattr(top_k, "meetings", lambda *a: (met.append(whole(*a).count()), whole(*a))[1])
    for n in (2_000, 10_000):
        rng = np.random.default_rng(1)
        m = rng.normal(size=(n, 8)) + 1
        m *= (1000 / (1 + np.arange(n)[rng.permutation(n)]))[:, None]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
        assert top_k.top_k(df).count() == 20 * -(-n // 20)
    assert met[1] <= 6 * met[0], met
