"""Fixed windows of next-token pairs over the concatenated stream of a split."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.shared import bounded_batches

#: About so many tokens of a stream are cut into windows in one task at a time.
STRETCH_TOKENS = 1 << 16
_PAIR = "x array<int>, y array<int>"


def _records(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
    """split, tok_start and ids of each record of (split, tokens, tok_start)."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)
    sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    for split, at, end, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ends.tolist(), sizes.tolist(), strict=True):
        if size:
            yield split, at, flat[end - size : end]


def _halo(stretch: int, block: int):
    """Each record's ids for every stretch that it lies in; what follows a stretch by up to ``block`` ids belongs to it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for split, at, ids in _records(batch):
                for k in range(max(0, (at - block) // stretch), (at + len(ids) - 1) // stretch + 1):
                    first, last = max(at, k * stretch), min(at + len(ids), (k + 1) * stretch + block)
                    if first < last:
                        rows.append((split, k, first, ids[first - at : last - at].tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["split", "stretch", "at", "packed"])

    return run


def _joined(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.sort_by("at")["packed"].to_pylist()), "<i4")


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows, np.int32).ravel()))


def _cut(stretch: int, block: int, stride: int):
    def run(table: pa.Table) -> pa.Table:
        ids, first = _joined(table), table["stretch"][0].as_py() * stretch
        starts = np.arange(-first % stride, min(stretch, max(len(ids) - block, 0)), stride)
        held = np.lib.stride_tricks.sliding_window_view(ids, block + 1)[starts] if len(starts) else np.zeros((0, block + 1), np.int32)
        return pa.table({"split": pa.array(table["split"].to_pylist()[:1] * len(starts), pa.string()), "start": pa.array(starts + first, pa.int64()), "x": _lists(held[:, :-1]), "y": _lists(held[:, 1:])})

    return run


def next_token_windows(encoded: DataFrame, block: int, stride: int) -> DataFrame:
    """split, start, x, y of the windows that start at every ``stride`` tokens and fit with one token more.

    ``encoded`` holds split, tokens and tok_start. Streams are cut into stretches of
    about STRETCH_TOKENS; each record sends its ids, packed, to the stretches it lies
    in and to one that it follows by at most ``block`` ids. So each stretch has the
    head of the next and cuts its windows alone, after one exchange. A window crosses
    records; a stream of ``block`` tokens or fewer has none.
    """
    bounded_batches(encoded.sparkSession)
    stretch = max(1, STRETCH_TOKENS // stride) * stride
    packed = encoded.select("split", "tokens", "tok_start").mapInArrow(_halo(stretch, block), "split string, stretch long, at long, packed binary")
    return packed.groupBy("split", "stretch").applyInArrow(_cut(stretch, block, stride), f"split string, start long, {_PAIR}")


def _met(starts: dict[str, np.ndarray], block: int):
    """Each record's ids for every window that it meets; ``starts`` ascend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for split, at, ids in _records(batch):
                own = starts.get(split, np.zeros(0, np.int64))
                for start in own[np.searchsorted(own, at - block) : np.searchsorted(own, at + len(ids))].tolist():
                    first, last = max(at, start), min(at + len(ids), start + block + 1)
                    rows.append((split, start, first, ids[first - at : last - at].tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["split", "start", "at", "packed"])

    return run


def _window(table: pa.Table) -> pa.Table:
    ids = _joined(table)[None, :]
    return pa.table({"split": table["split"].slice(0, 1), "start": table["start"].slice(0, 1), "x": _lists(ids[:, :-1]), "y": _lists(ids[:, 1:])})


def draw_starts(tokens: dict[str, int], n: int, block: int, seed: int = 42) -> list[tuple[int, str, int]]:
    """(sample, split, start): n hashed places in [0, tokens - block - 1) of each split; one too short has none."""
    place = lambda split, sample: int(sha256(f"{seed}:{split}:{sample}".encode()).hexdigest()[:15], 16)
    return [(sample, split, place(split, sample) % (size - block - 1)) for split, size in tokens.items() if size - block - 1 > 0 for sample in range(n)]


def sample_windows(encoded: DataFrame, n: int, block: int, seed: int = 42, tokens: dict[str, int] | None = None) -> DataFrame:
    """sample, split, start, x, y of n windows of each split at hashed starts, with replacement.

    A start lies in [0, tokens - block - 1); splits too short for one have none. The
    starts, n for each split, are sorted and sent to the tasks; a record finds those
    that it meets by binary search and sends on their ids only. ``tokens`` are the
    lengths of the streams; where they are not given, ``encoded`` is read for them.
    """
    spark = encoded.sparkSession
    bounded_batches(spark)
    if tokens is None:
        tokens = {r.split: r.n for r in encoded.groupBy("split").agg(F.sum(F.size("tokens")).alias("n")).collect() if r.n}
    drawn = draw_starts(tokens, n, block, seed)
    starts = {split: np.array(sorted({at for _, s, at in drawn if s == split}), np.int64) for split in tokens}
    pieces = encoded.select("split", "tokens", "tok_start").mapInArrow(_met(starts, block), "split string, start long, at long, packed binary")
    cut = pieces.groupBy("split", "start").applyInArrow(_window, f"split string, start long, {_PAIR}")
    samples = spark.createDataFrame(drawn, "sample long, split string, start long")
    return samples.join(cut, ["split", "start"]).select("sample", "split", "start", "x", "y")
