import math
from hashlib import sha256

import numpy as np
import pytest
from compare import SF, same

from corpusloom.llm import clusters
from corpusloom.llm.oracles import oracle_sql
from corpusloom.llm.queries import queries


def brute(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    if not centroids:
        return []
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    total = [sum(d for d, c in at if c == j) for j in range(len(centroids))]
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, total[c], sum(total), names[c]) for (i, _), (d, c) in zip(kept, at)), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(v, i, 0, 1) for i, v in rows], "embedding array<float>, vec_id long, cluster int, `a.b` int").repartition(6)


def exact(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("kind", ["spread", "groups", "flat", "equal", "large"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 64))
    make = {
        "spread": lambda: rng.normal(size=64),
        "groups": lambda: centres[rng.integers(9)] + 0.05 * rng.normal(size=64),
        "flat": lambda: np.pad(rng.integers(-2, 3, 2) / 64, (0, 62)),
        "equal": lambda: np.ones(64) / 2,
        "large": lambda: rng.normal(size=64) * 2e5,
    }[kind]
    rows = [(i, [float(x) for x in make()]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(100)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[8][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [float("nan")] * 64), (904, [None] + [1.0] * 63), (905, [float("-inf")] * 64)]
    assert sorted(map(tuple, clusters.cluster_vectors(table(spark, rows)).collect()), key=repr) == brute(exact(rows))


def test_few_and_none(spark):
    rows = exact([(i, [i / 7] * 64) for i in range(3)])
    assert sorted(map(tuple, clusters.cluster_vectors(table(spark, rows)).collect()), key=repr) == brute(rows)
    assert clusters.cluster_vectors(table(spark, rows).where("false")).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    for data in (rng.integers(-300, 300, (500, 64)), np.repeat(rng.integers(-300, 300, (20, 64)), 25, axis=0) + rng.integers(-4, 4, (500, 64)), rng.integers(-1, 2, (500, 2))):
        simplex = clusters.Simplex(clusters.choose_pivots(data[:256]))
        apex = simplex.apexes(clusters._squared(data, simplex.pivots))
        low, high = clusters.bounds(apex, apex[:40])
        true = clusters._squared(data, data[:40])
        assert (low <= true).all() and (true <= high).all()
    # Vectors in groups: the bounds leave few centroids to compare.
    data = np.repeat(rng.integers(-300, 300, (16, 64)), 30, axis=0) + rng.integers(-4, 4, (480, 64))
    simplex = clusters.Simplex(clusters.choose_pivots(data[rng.permutation(480)[:256]]))
    apex, centre = (simplex.apexes(clusters._squared(x, simplex.pivots)) for x in (data, data[::30]))
    low, high = clusters.bounds(apex, centre)
    assert (low <= high.min(axis=1, keepdims=True)).sum() < 1.5 * len(data)


def test_component_beyond_the_limit_fails_the_job(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        clusters.cluster_vectors(table(spark, [(0, [1e9] * 64)])).collect()


def test_query_matches_sql(spark):
    same(spark, SF, queries()["op12_centroid_clustering"], oracle_sql()["op12_centroid_clustering"])
