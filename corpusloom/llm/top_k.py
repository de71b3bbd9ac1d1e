"""Exact top-k search by inner products over norm-sorted vectors.

Vectors become integers and are rotated by the eigenvectors of their second
moments, the right singular vectors of the table, so that the first coordinates
carry most of a product. Candidates are sorted by descending length and packed in
blocks. Every query meets the block of longest candidates first, which gives a
score that its k-th best reaches at least; by Cauchy-Schwarz a block whose greatest
length can't reach that score for any query of a block is not sent to it. A task
runs one block of queries over the blocks of one slice: it stops at the first
block that cannot matter any more, forms partial sums of the first rotated
coordinates for the rest, adds the Cauchy-Schwarz bound of the residuals, and
computes exact integer products only where that sum can still reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._shared import bounded_batches, materialize

SCALE = 64
BLOCK = 2048
QUERY_BLOCK = 2048
#: Blocks of a slice at most, which a task runs over one after another.
SLICE_BLOCKS = 64
HEAD = 16
#: Bounds are computed in floating point, so they are widened by this share.
SLACK = 1e-6
_NO_ID = 2**63 - 1
_LEAST, _MOST = -(2**63), 2**63 - 1


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """rid, vec_id, v (whole numbers as doubles, which hold them exactly), norm.

    Vectors that are null or hold null or non-finite components are left out, and
    those with a component whose product with ``scale`` is no finite double.
    """
    scaled = F.transform("embedding", lambda x: x.cast("double") * float(scale))
    usable = F.col("embedding").isNotNull() & F.forall(scaled, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = F.transform(scaled, lambda x: F.when(F.rint(x) > x, F.rint(x) - 1).otherwise(F.rint(x)))
    whole = vectors.where(usable).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return whole.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def product_kind(dims: int, largest: float) -> str:
    """How products are exact: in doubles below 2**53, in longs below 2**63, else in Python's integers."""
    most = dims * int(largest) ** 2
    return "double" if most < 2**53 else "long" if most < 2**63 else "any"


def products(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """The inner product of each row of ``a`` with that of ``b`` as a long; one that doesn't fit counts as the nearest long."""
    if kind == "any":
        exact = (sum(map(mul, map(int, x), map(int, y))) for x, y in zip(a.tolist(), b.tolist(), strict=True))
        return np.array([min(max(p, _LEAST), _MOST) for p in exact], np.int64)
    if kind == "long":
        a, b = a.astype(np.int64), b.astype(np.int64)
    step = 65_536
    return np.concatenate([np.einsum("ij,ij->i", a[i : i + step], b[i : i + step]) for i in range(0, len(a), step)] or [np.zeros(0)]).astype(np.int64)


def _moments(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            m = _matrix(batch.column(0), dims)
            total += m.T @ m
        i, j = np.divmod(np.arange(dims * dims), dims)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "x"])

    return run


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), dims))
    out[np.arange(dims)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _lengths(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m * m).sum(axis=1))


_FIELDS = [("part", pa.int64()), ("block", pa.int64()), ("top", pa.float64()), ("need", pa.float64()), ("rids", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary()), ("floors", pa.binary())]
_BLOCK_SCHEMA = "part long, block long, top double, need double, rids binary, ids binary, vectors binary, floors binary"


def _blocks(dims: int, size: int, wire: str):
    """rid, vec_id, v, floor, need in order in; blocks of them as bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                rows = batch.slice(at, size)
                m = _matrix(rows.column(2), dims)
                ids = rows.column(1).fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                floors, need = rows.column(3).to_numpy(zero_copy_only=False), rows.column(4).to_numpy(zero_copy_only=False)
                values = [part, number, float(_lengths(m).max()), float(need.min()), rows.column(0).to_numpy(zero_copy_only=False).tobytes(), ids.tobytes(), m.astype(wire).tobytes(), floors.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, (_, kind) in zip(values, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])
                number += 1

    return run


def _vectors(row: dict, wire: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rids, ids and the matrix of a block."""
    rids = np.frombuffer(row["rids"], np.int64)
    return rids, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], wire).reshape(len(rids), -1).astype(np.float64)


def _floors(lead: dict, dims: int, k: int, wire: str, kind: str):
    """rid, vec_id, v in; with them the score that the query's k-th best reaches at least, and the length a candidate needs for it."""
    rids, _, long_ones = _vectors(lead, wire)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(2), dims)
            own = batch.column(0).to_numpy(zero_copy_only=False)
            floors = np.full(len(m), _LEAST)
            for i in range(len(m)):
                others = long_ones[rids != own[i]]
                if len(others) >= k:
                    floors[i] = np.partition(products(np.broadcast_to(m[i], others.shape), others, kind), -k)[-k]
            length = _lengths(m)
            reach = floors.astype(np.float64)
            slack = SLACK * (1 + np.abs(reach))
            need = np.where((length > 0) & (reach - slack > 0) & (floors > _LEAST), (reach - slack) / np.maximum(length * (1 + SLACK), 1e-300), -np.inf)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(floors), pa.array(need)], names=["rid", "vec_id", "v", "floor", "need"])

    return run


class _Queries:
    """A block of queries and their best candidates so far."""

    def __init__(self, row: dict, rotation: np.ndarray, k: int, wire: str, kind: str) -> None:
        self.k, self.rotation, self.wire, self.kind = k, rotation, wire, kind
        self.rids, self.ids, self.whole = _vectors(row, wire)
        self.floors = np.frombuffer(row["floors"], np.int64)
        self.rotated = self.whole @ rotation
        self.norm = _lengths(self.whole)
        self.rest = _lengths(self.rotated[:, HEAD:])
        self.score = np.full((len(self.rids), k), _LEAST)
        self.found = np.full((len(self.rids), k), _NO_ID)
        self.filled = np.zeros(len(self.rids), np.int64)

    def least(self) -> np.ndarray:
        """The score that a candidate must have to matter."""
        return np.maximum(self.floors, np.where(self.filled >= self.k, self.score[:, -1], _LEAST))

    def meet(self, row: dict) -> bool:
        """Take in a block of candidates; false if no later block can matter."""
        least = self.least()
        reach = np.where(least > _LEAST, least.astype(np.float64), -np.inf)
        with np.errstate(over="ignore", invalid="ignore"):
            slack = SLACK * (1 + self.norm * row["top"])
            open_ = np.flatnonzero(~(self.norm * row["top"] + slack < reach))
            if not len(open_):
                return False
            rids, ids, whole = _vectors(row, self.wire)
            rotated = whole @ self.rotation
            rest = _lengths(rotated[:, HEAD:])
            bound = self.rotated[open_, :HEAD] @ rotated[:, :HEAD].T + self.rest[open_, None] * rest
            # What overflows is no number and rules nothing out.
            q, c = np.nonzero(~(bound + slack[open_, None] < reach[open_, None]) & (rids != self.rids[open_, None]))
        q = open_[q]
        if self.kind == "double" and len(q) * 4 > len(open_) * len(rids):
            score = (self.whole[open_] @ whole.T).astype(np.int64)[np.searchsorted(open_, q), c]
        else:
            step = 65_536
            score = np.concatenate([products(self.whole[q[i : i + step]], whole[c[i : i + step]], self.kind) for i in range(0, len(q), step)] or [np.zeros(0, np.int64)])
        keep = score >= least[q]
        self._merge(q[keep], score[keep], ids[c[keep]])
        return True

    def _merge(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(q)
        held = np.arange(self.k)[None, :] < self.filled[touched, None]
        owner = np.concatenate((np.repeat(touched, held.sum(axis=1)), q))
        score = np.concatenate((self.score[touched][held], score))
        ids = np.concatenate((self.found[touched][held], ids))
        order = np.lexsort((ids, ~score, owner))  # ~ turns the order of longs round without overflow
        owner, score, ids = owner[order], score[order], ids[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = rank < self.k
        self.score[owner[keep], rank[keep]], self.found[owner[keep], rank[keep]] = score[keep], ids[keep]
        self.filled[touched] = np.minimum(np.bincount(owner, minlength=len(self.rids))[touched], self.k)

    def rows(self) -> pa.RecordBatch:
        held = np.arange(self.k)[None, :] < self.filled[:, None]
        times = held.sum(axis=1)
        ids = self.found[held]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.rids, times)), pa.array(np.repeat(self.ids, times)), pa.array(ids, mask=ids == _NO_ID), pa.array(self.score[held])], names=["rid", "query_id", "vec_id", "score"])


def _search(rotation: np.ndarray, k: int, wire: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Queries | None = None
        open_ = True
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if now is not None:
                        yield now.rows()
                    now, open_ = _Queries(row, rotation, k, wire, kind), True
                elif now is not None and open_:
                    open_ = now.meet(row)
        if now is not None:
            yield now.rows()

    return run


_SENT = ["rids", "ids", "vectors", "floors", "top"]


def meetings(candidates: DataFrame, asked: DataFrame, slices: int) -> DataFrame:
    """slice, q_part, q_block and a block of candidates for each block of queries that it can matter to."""
    wanting = asked.select("slice", F.col("part").alias("q_part"), F.col("block").alias("q_block"), F.col("need").alias("q_need"))
    numbered = candidates.withColumn("slice", F.pmod(F.hash("part", "block"), F.lit(slices)))
    return numbered.join(wanting, "slice").where("top >= q_need").select("slice", "q_part", "q_block", *_SENT)


def top_k(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer products of each query with all other rows.

    ``vectors`` holds vec_id and embedding; components x become floor(64 x). Ties go
    to the smaller vec_id, a null one last. A query's own row takes no part, another
    row of the same vec_id does; repeated query rows count once in the numbering of
    ranks each. Shorter vectors are filled up with zeros. Products are exact whatever
    the size of the components; one that doesn't fit a long counts as the nearest
    long. Other columns are ignored; an empty table, or one without queries, gives no
    rows.

    Queries are a stated share of the rows and meet candidates in blocks. What is
    collected or broadcast is bounded: second moments, one block of candidates.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    whole = materialize(whole_vectors(vectors), "vectors")
    count, dims, largest = whole.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not count or not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind, wire = product_kind(dims, largest), "<i4" if largest < 2**31 else "<f8"
    moments = np.zeros((dims, dims))
    for r in whole.select("v").mapInArrow(_moments(dims), "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        moments[r.i, r.j] = r.x
    rotation = np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy() if np.isfinite(moments).all() else np.eye(dims)

    columns = ["rid", "vec_id", "v"]
    # rid parts vectors of one length, so that a very common vector is no hot range.
    by_length = whole.repartitionByRange(F.desc("norm"), "rid").sortWithinPartitions(F.desc("norm"), "rid")
    plain = by_length.select(*columns, F.lit(_LEAST).alias("floor"), F.lit(float("-inf")).alias("need"))
    candidates = materialize(plain.mapInArrow(_blocks(dims, BLOCK, wire), _BLOCK_SCHEMA), "blocks")
    lead = candidates.orderBy(F.desc("top"), "part", "block").first().asDict()
    asked = whole.where(is_query).select(columns).mapInArrow(_floors(lead, dims, k, wire, kind), "rid long, vec_id long, v array<double>, floor long, need double")
    asked = materialize(asked, "queries").repartitionByRange(F.desc("need"), "rid").sortWithinPartitions(F.desc("need"), "rid")
    asked = materialize(asked.mapInArrow(_blocks(dims, QUERY_BLOCK, wire), _BLOCK_SCHEMA), "blocks")

    blocks, query_blocks = candidates.count(), max(1, asked.count())
    slices = min(blocks, max(-(-blocks // SLICE_BLOCKS), -(-2 * spark.sparkContext.defaultParallelism // query_blocks)))
    every = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    sent = every.select("slice", F.col("part").alias("q_part"), F.col("block").alias("q_block"), F.lit(0).alias("kind"), *_SENT)
    work = sent.unionByName(meetings(candidates, every, slices).withColumn("kind", F.lit(1)))
    keys = ["q_part", "q_block", "slice"]
    found = work.repartition(*keys).sortWithinPartitions(*keys, "kind", F.desc("top")).select("kind", *_SENT).mapInArrow(_search(rotation, k, wire, kind), "rid long, query_id long, vec_id long, score long")
    best = Window.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
