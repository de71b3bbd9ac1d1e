"""Nearest centroids by n-simplex projection, and rounds of exact integer means.

Each vector's distances to a few pivots are computed once. They place the vector as
the apex of a simplex over the pivots: coordinates inside the pivots' space and a
height above it. Two apexes on the same side are never farther apart than the
vectors, two on opposite sides never nearer, so both bounds of a distance come from
a few coordinates instead of all components. A centroid whose lower bound is above
the least upper bound of any is out; the others are compared in exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._shared import bounded_batches, materialize

SCALE, DIMS, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Pivots, and the vectors of smallest hash among which they are sought; both bounded.
PIVOTS, PIVOT_SAMPLE = 24, 256
#: Squared distances are exact in longs up to components of this size.
LARGEST = 1 << 27
#: Bounds are floating point, heights the root of a difference; both are widened by this share of the squared sizes met.
SLACK = 1e-4
_ROWS = 4096


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, whole numbers, of the vectors that have ``dims`` components, none null or non-finite."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fits = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") == dims) & fits
    v = F.transform(x, lambda c: F.when(F.abs(c) * scale <= LARGEST, F.floor(c * float(scale))).otherwise(F.raise_error(F.lit(f"a component times {scale} exceeds {LARGEST}: squared distances would not fit a long"))).cast("int"))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all of the few rows of ``b``."""
    a = a.astype(np.int64)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b.astype(np.int64)], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


class Simplex:
    """Pivots at known distances; places further points by their distances to the pivots alone."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        between = _squared(pivots, pivots).astype(float)
        #: Row i holds the coordinates of pivot i + 1; the first pivot is the origin.
        self.base = np.zeros((len(pivots) - 1, len(pivots) - 1))
        for i in range(len(self.base)):
            at, height = self._place(between[i + 1 : i + 2, : i + 1], i)
            self.base[i, :i], self.base[i, i] = at[0], height[0]

    def _place(self, squared: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates and heights over the first n + 1 pivots."""
        base = self.base[:n, :n]
        right = (squared[:, :1] + (base**2).sum(axis=1) - squared[:, 1 : n + 1]) / 2
        at = np.linalg.solve(base, right.T).T if n else np.zeros((len(squared), 0))
        return at, np.sqrt(np.maximum(squared[:, 0] - (at**2).sum(axis=1), 0))

    def apexes(self, squared: np.ndarray) -> np.ndarray:
        """One row for each point: its coordinates, the height last."""
        at, height = self._place(squared.astype(float), len(self.base))
        return np.column_stack((at, height))


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Pivots of a sample, each the farthest from the space of those before it, while that space grows well."""
    if not len(sample):
        return sample
    rest = sample.astype(float) - sample[0].astype(float)
    chosen, first = [0], None
    while len(chosen) < most:
        height = np.sqrt((rest**2).sum(axis=1))
        k = int(height.argmax())
        first = height[k] if first is None else first
        if height[k] <= 1e-2 * first or height[k] == 0:
            break
        chosen.append(k)
        unit = rest[k] / height[k]
        rest = rest - np.outer(rest @ unit, unit)
    return sample[chosen]


def bounds(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds of the distance of each point to each centre, from their apexes."""
    p, c = points[:, :-1], centres[:, :-1]
    inside = np.maximum((p**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * p @ c.T, 0)
    h, g = points[:, -1:], centres[:, -1]
    slack = SLACK * ((points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) + 1)
    return inside + (h - g) ** 2 - slack, inside + (h + g) ** 2 + slack


def nearest(v: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid, the smaller of equals, and the exact squared distance."""
    low, high = bounds(apexes, centres)
    left = low <= high.min(axis=1, keepdims=True)
    row, number = np.nonzero(left)
    difference = v[row].astype(np.int64) - centroids[number]
    exact = np.full(left.shape, np.iinfo(np.int64).max)
    exact[row, number] = np.einsum("ij,ij->i", difference, difference)
    best = exact.argmin(axis=1)
    return best, exact[np.arange(len(v)), best]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _placing(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simplex = Simplex(pivots)
        for batch in _blocks(batches):
            apexes = simplex.apexes(_squared(_matrix(batch.column(1), pivots.shape[1]), pivots))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(apexes) + 1, dtype=np.int32) * apexes.shape[1]), pa.array(apexes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "v", "apex"])

    return run


def _each_nearest(pivots: np.ndarray, centroids: np.ndarray):
    """For each block of (vec_id, v, apex): ids, vectors, numbers, squared distances."""

    def run(batches: Iterator[pa.RecordBatch]):
        centres = Simplex(pivots).apexes(_squared(centroids, pivots))
        for batch in _blocks(batches):
            v, apexes = _matrix(batch.column(1), centroids.shape[1]), _matrix(batch.column(2), centres.shape[1])
            yield (batch.column(0), v, *nearest(v, apexes, centroids, centres))

    return run


def _summing(pivots: np.ndarray, centroids: np.ndarray):
    each = _each_nearest(pivots, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, v, number, _ in each(batches):
            k = np.unique(number)
            sums = [v[number == i].sum(axis=0, dtype=np.int64).tolist() for i in k]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([int((number == i).sum()) for i in k], pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigning(pivots: np.ndarray, centroids: np.ndarray):
    each = _each_nearest(pivots, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, number, squared in each(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(squared, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def _moved(points: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the exact floor of its vectors' means; one without vectors stays. Reads a row for each centroid."""
    parts = points.mapInArrow(_summing(pivots, centroids), "cluster int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
        out[row.cluster] = [int(s) // row.n for s in row[2:]]
    return out


def seeded(vec_id: Column, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))).cast("binary"), 256)


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Vectors that are null, of another length than ``dims`` or hold null or non-finite
    components take no part; a component beyond LARGEST / SCALE fails the job. The
    first centroids are the ``k`` vectors of smallest hash of their ids, a null id
    hashed as an empty one, rows of one id in the order of their vectors; fewer
    vectors make fewer centroids, none an empty result. Repeated rows count each.
    Other columns are dropped. An inertia beyond a long is null.

    Vectors are read once and written with their apexes; each round reads those and
    returns sums, one row for each centroid, to the driver.
    """
    bounded_batches(vectors.sparkSession)
    whole = materialize(whole_vectors(vectors, dims), "vectors")
    first = [r.v for r in whole.orderBy(seeded(F.col("vec_id"), seed), "v").limit(max(k, PIVOT_SAMPLE)).select("v").collect()]
    sample = np.array(first, np.int64).reshape(-1, dims)
    centroids, pivots = sample[:k].copy(), choose_pivots(sample)
    empty = vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if not len(centroids):
        return empty
    points = materialize(whole.mapInArrow(_placing(pivots), "vec_id long, v array<int>, apex array<double>"), "points")
    for _ in range(rounds):
        centroids = _moved(points, pivots, centroids)
    assigned = materialize(points.mapInArrow(_assigning(pivots, centroids), "vec_id long, cluster int, distance long"), "assigned")
    digests = [(i, sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    names = vectors.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    whole_sum = F.sum("own").over(Window.partitionBy(F.lit(0)))  # a row for each centroid
    sums = sums.select("cluster", F.col("own").try_cast("long").alias("cluster_inertia"), whole_sum.try_cast("long").alias("inertia")).join(names, "cluster")
    return assigned.join(F.broadcast(sums), "cluster").select(*empty.columns)
