"""Repeated passages, found with enhanced suffix arrays, and their removal.

A text is a sequence of symbols: its bytes, or its words. Every window of so many
symbols is filed under the least hash of the short grams in it. Equal windows have
equal least hashes, so it is enough to compare inside a file. Neighbouring windows
mostly share their file, so a document becomes a short list of runs, and only
hashes of runs are shuffled. A run whose whole content occurs twice is repeated as
it stands: copies of one string make one interval, whose leaves are known. Where a
file holds different contents, one of each is fetched and a suffix array over them
is built: sorted suffixes with the lengths of their common prefixes. A scan with a
stack walks the tree of common-prefix intervals; an interval whose suffixes don't
all have the same symbol before them is a maximal repeat, and all its occurrences
are put out.

A file of more than ``LARGEST_FILE`` contents is not gathered in one task. Its
contents are filed anew by longer grams, which part windows that share a short
gram only, and the same is done with those files. The last grams are as long as a
window, so a file is then the windows that are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.functions.text import named
from corpusloom.llm import _bytes as B
from corpusloom.llm._shared import BATCH_BYTES, bounded_batches, frugal, materialize
from corpusloom.llm.shingles import word_spans

#: Symbols of the shortest repeat, and of the grams that name files, by unit.
LENGTH = 400
PASSAGE_WORDS = 50
GRAMS = {"bytes": 32, "words": 5}
#: How symbols are written where they are sorted or shuffled.
_CODES = {"bytes": np.dtype("u1"), "words": np.dtype(">u4")}
#: A run is cut after so many windows, which matters in monotonous texts only.
LONGEST_RUN = 1024
LARGEST_FILE = 2000
#: Windows of a document that are looked at together.
SEGMENT = B.CHUNK_BYTES
#: Bytes of documents whose runs are found together; temporaries take about 90 times as much.
RUN_BYTES = {"bytes": B.CHUNK_BYTES // 4, "words": B.CHUNK_BYTES}

_NO_ID = -(2**63)


def symbols(unit: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all symbols of a chunk, and the offsets of its documents in them."""
    if unit == "bytes":
        return data, offsets
    starts, ends = word_spans(data, offsets)
    return (B.hash_spans(data, starts, ends) >> np.uint64(32)).astype(np.uint32), np.searchsorted(starts, offsets)


def _hashes(codes: np.ndarray) -> np.ndarray:
    return B.BYTE_HASH[codes] if codes.dtype == np.uint8 else B.mix64((codes.astype(np.uint64) + np.uint64(1)) * B._ODD)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def find_runs(codes: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, file, content hash, may repeat inside) of each run of a chunk."""
    none = np.zeros(0, np.int64)
    width = length - gram + 1
    if len(codes) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    prefix = B.prefix_hash(_hashes(codes))
    start = np.arange(len(codes) - gram + 1)
    grams = B.span_hash(prefix, start, start + gram)
    least = _sliding_least(grams, width)
    valid = np.zeros(len(least) + 1, np.int8)
    size = np.diff(offsets)
    long = size >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, (offsets[1:] - length + 1)[long], -1)
    valid = np.cumsum(valid[:-1]) > 0
    change = np.ones(len(least), bool)
    change[1:] = least[1:] != least[:-1]
    change[offsets[:-1][offsets[:-1] < len(least)]] = True
    change[1:] |= valid[1:] != valid[:-1]
    first = np.flatnonzero(change & valid)
    stop = np.append(np.flatnonzero(change), len(least))
    stop = stop[np.searchsorted(stop, first, side="right")]
    pieces = -(-(stop - first) // LONGEST_RUN)
    begin = np.repeat(first, pieces) + LONGEST_RUN * B.ranges(np.zeros(len(first), np.int64), pieces)
    count = np.minimum(np.repeat(stop, pieces) - begin, LONGEST_RUN)
    files = least[begin]
    # Where a least gram stands twice near itself, windows of one run may be equal.
    padded = np.concatenate((np.full(width - 1, np.iinfo(np.uint64).max, np.uint64), ~least, np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)))
    chosen = np.flatnonzero(~_sliding_least(padded, width) == grams)
    order = chosen[np.argsort(grams[chosen], kind="stable")]
    near = (grams[order[1:]] == grams[order[:-1]]) & (order[1:] - order[:-1] <= width + LONGEST_RUN)
    multi = np.isin(files, grams[order[1:][near]])
    content = B.span_hash(prefix, begin, begin + count + length - 1)
    doc = B.doc_of(offsets, begin)
    return doc, begin - offsets[doc], count, files, content, multi


def _segments(codes: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, its first window, codes, offsets): whole short documents, and stretches of windows of a long one."""
    if len(offsets) != 2 or len(codes) <= 2 * SEGMENT:
        yield 0, 0, codes, offsets
        return
    for at in range(0, len(codes) - length + 1, SEGMENT):
        part = codes[at : at + SEGMENT + length - 1]
        yield 0, at, part, np.array([0, len(part)])


def _runs(unit: str, length: int):
    names = ["did", "th", "g", "c", "a", "n", "multi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = B.text_buffers(batch.column(2))
            for a, _, part, off in B.chunks(data, offsets, RUN_BYTES[unit]):
                for _, at, codes, own in _segments(*symbols(unit, part, off), length):
                    doc, begin, count, files, content, multi = find_runs(codes, own, length, GRAMS[unit])
                    arrays = [ids[a + doc], hashes[a + doc], files.view(np.int64), content.view(np.int64), (begin + at).astype(np.int32), count.astype(np.int32), multi]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """did and th, which tell rows apart (a null id is the least long), and the text, null as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def _squeezed(docs: DataFrame) -> DataFrame:
    """did, th and the compressed text, so that less is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = B.text_buffers(batch.column(2))
            view = memoryview(data)
            packed = [press.compress(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["did", "th", "packed"])

    return _keyed(docs).mapInArrow(frugal(run), "did long, th long, packed binary")


def _opened(press: zstandard.ZstdDecompressor, packed: bytes | None) -> bytes:
    return press.decompress(packed, max_output_size=1 << 31) if packed else b""


def _bounded(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows in batches; the last field is bytes, of which a batch holds about BATCH_BYTES."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 100
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _fetch(unit: str, length: int):
    """Packed text and requests in; the symbols of each requested run out."""
    names = ["g", "c", "d", "several", "whole", "large", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary()]
    width = _CODES[unit].itemsize

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                text = np.frombuffer(_opened(press, row["packed"]), np.uint8)
                raw = symbols(unit, text, np.array([0, len(text)]))[0].astype(_CODES[unit]).tobytes()
                for r in row["runs"]:
                    yield (*(r[k] for k in names[:-1]), raw[r["a"] * width : (r["a"] + r["n"] + length - 1) * width])

    return lambda batches: _bounded(rows(batches), names, kinds)


def maximal_repeats(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """(length, positions of all occurrences) of each maximal repeat of at least ``length`` symbols.

    A repeat lies inside one of the strings that ``offsets`` delimit. Suffixes whose
    first ``length`` symbols occur once, or always after the same one, begin no
    maximal repeat and are left out before the array is sorted.
    """
    size = np.diff(offsets)
    windows = np.maximum(size - length + 1, 0)
    start = B.ranges(offsets[:-1], windows)
    if len(start) < 2:
        return
    prefix = B.prefix_hash(_hashes(data))
    key = B.span_hash(prefix, start, start + length)
    order = np.argsort(key, kind="stable")
    start, key = start[order], key[order]
    edge = np.flatnonzero(np.diff(key, prepend=key[0] + np.uint64(1)) != 0)
    count = np.diff(np.append(edge, len(key)))
    left = np.where(np.isin(start, offsets), -1 - start, data[np.maximum(start - 1, 0)].astype(np.int64))
    diverse = (np.minimum.reduceat(left, edge) != np.maximum.reduceat(left, edge)) & (count > 1)
    # Big-endian symbols sort as their bytes do.
    sorted_as = data.astype(_CODES["bytes" if data.dtype == np.uint8 else "words"])
    text, wide = sorted_as.tobytes(), sorted_as.itemsize
    end_of = offsets[np.searchsorted(offsets, start, side="right")]
    edge, count = edge[diverse], count[diverse]
    members = B.ranges(edge, count)
    first = np.cumsum(count) - count
    # Either order of two suffixes makes the same interval.
    for at, n in zip(first[count > 2].tolist(), count[count > 2].tolist(), strict=True):
        members[at : at + n] = sorted(members[at : at + n].tolist(), key=lambda i: text[start[i] * wide : end_of[i] * wide])
    suffix = start[members]
    known = np.full(len(members), length)
    known[first] = 0
    yield from _intervals(suffix, _common_prefixes(prefix, suffix, end_of[members], known[1:]), left[members])


def _common_prefixes(prefix: np.ndarray, suffix: np.ndarray, end: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many symbols neighbouring suffixes share, by bisection on span hashes; ``low`` are known to be equal, 0 where none are."""
    a, b = suffix[:-1], suffix[1:]
    high = np.where(low > 0, np.minimum(end[:-1] - a, end[1:] - b), 0)
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        same = B.span_hash(prefix, a, a + middle) == B.span_hash(prefix, b, b + middle)
        low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
    return low


def _intervals(suffix: np.ndarray, lcp: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Stack scan: each interval of the tree that is diverse to the left."""
    stack: list[tuple[int, int]] = []  # depth, first suffix
    for i, depth in enumerate([*lcp.tolist(), 0], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            reach, first = stack.pop()
            before = left[first:i]
            if before.min() != before.max():
                yield reach, suffix[first:i]
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


_FOUND = "g long, c long, s long, e long, grp long"


def _solve(unit: str, length: int, across: bool, groups: bool):
    """Contents sorted by file in; what repeats in them out.

    With ``groups`` each occurrence of each maximal repeat is a row, and grp tells
    repeats apart; without, the occurrences in a content are joined to spans.
    """

    def solve(rows: list[dict]) -> pa.RecordBatch:
        codes = np.frombuffer(b"".join(r["bytes"] for r in rows), _CODES[unit])
        codes = codes.astype(codes.dtype.newbyteorder("="))
        offsets = np.concatenate(([0], np.cumsum([len(r["bytes"]) // _CODES[unit].itemsize for r in rows])))
        doc, several = np.array([r["d"] for r in rows]), np.array([r["several"] for r in rows])
        mask = np.zeros(len(codes) + 1, np.int64)
        out: list[tuple] = []
        prefix = B.prefix_hash(_hashes(codes)) if groups else None
        for size, places in maximal_repeats(codes, offsets, length):
            holder = B.doc_of(offsets, places) if across or groups else places
            if across and not several[holder].any() and doc[holder].min() == doc[holder].max():
                continue
            if groups:
                name = int(B.span_hash(prefix, places[:1], places[:1] + size).view(np.int64)[0])
                out += [(rows[h]["g"], rows[h]["c"], s, s + size, name) for h, s in zip(holder.tolist(), (places - offsets[holder]).tolist(), strict=True)]
            else:
                mask[places] += 1  # places of one repeat differ
                mask[places + size] -= 1
        covered = np.cumsum(mask[:-1]) > 0
        for r, a, b in zip(rows, offsets[:-1], offsets[1:], strict=True) if not groups else ():
            if not r["whole"]:
                inside = np.concatenate(([False], covered[a:b], [False])).astype(np.int8)
                turn = np.flatnonzero(np.diff(inside))
                out += [(r["g"], r["c"], int(s), int(e), 0) for s, e in zip(turn[::2], turn[1::2], strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["g", "c", "s", "e", "grp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= B.CHUNK_BYTES and row["g"] != held[-1]["g"]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["bytes"])
        if held:
            yield solve(held)

    return run


def _refile(unit: str, length: int, gram: int):
    """Contents of large files in; their runs by longer grams out, with their symbols."""
    names = ["pg", "pc", "d", "several", "g", "c", "a", "n", "multi", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    width = _CODES[unit].itemsize

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                codes = np.frombuffer(r["bytes"], _CODES[unit])
                codes = codes.astype(codes.dtype.newbyteorder("="))
                _, begin, count, files, content, multi = find_runs(codes, np.array([0, len(codes)]), length, gram)
                for a, n, g, c, m in zip(begin.tolist(), count.tolist(), files.view(np.int64).tolist(), content.view(np.int64).tolist(), multi.tolist(), strict=True):
                    yield r["g"], r["c"], r["d"], r["several"], g, c, a, n, m, r["bytes"][a * width : (a + n + length - 1) * width]

    return (lambda batches: _bounded(rows(batches), names, kinds)), "pg long, pc long, d long, several boolean, g long, c long, a int, n int, multi boolean, bytes binary"


def _contents(runs: DataFrame, doc: Column, several: Column, across: bool) -> DataFrame:
    """g, c, multi, d, several, whole and one place of each distinct content of the files in which something may repeat."""
    meets = F.min(doc) != F.max(doc)
    files = runs.groupBy("g").agg(F.count("*").alias("k"), F.max("multi").alias("m"), (meets | F.max(several)).alias("met"))
    files = files.where("met" if across else "k > 1 or m").select("g")
    one = [c for c in ("did", "th", "a") if c in runs.columns]
    found = runs.join(files, "g").groupBy("g", "c").agg(F.count("*").alias("copies"), F.max("multi").alias("multi"), F.min(doc).alias("d"), (meets | F.max(several)).alias("several"), F.min(F.struct(*one, "n")).alias("o"))
    whole = F.col("several") if across else F.col("copies") > 1
    return found.select("g", "c", "multi", "d", "several", whole.alias("whole"), "o.*")


def _open_files(contents: DataFrame, across: bool) -> DataFrame:
    """g and large of the files in which some content is not repeated as a whole, but may be in part."""
    files = contents.groupBy("g").agg(F.bool_and("whole").alias("done"), F.count("*").alias("k"), F.max("multi").alias("m"), ((F.min("d") != F.max("d")) | F.max("several")).alias("met"))
    return files.where("not done and " + ("k > 1 and met" if across else "(k > 1 or m)")).select("g", (F.col("k") > LARGEST_FILE).alias("large"))


def _within(contents: DataFrame, fetched: DataFrame, unit: str, length: int, across: bool, groups: bool, grams: list[int]) -> DataFrame:
    """g, c, s, e, grp: what repeats of each content; ``grams`` are those that large files are filed by next."""
    whole = contents.where("whole").select("g", "c", F.lit(0).cast("long").alias("s"), (F.col("n") + length - 1).cast("long").alias("e"), F.col("c").alias("grp"))
    small = fetched.where("not large") if grams else fetched
    solved = small.repartition("g").sortWithinPartitions("g").mapInArrow(frugal(_solve(unit, length, across, groups)), _FOUND)
    found = whole.unionAll(solved)
    if not grams or not fetched.where("large").head(1):
        return found
    run, schema = _refile(unit, length, grams[0])
    runs = materialize(fetched.where("large").mapInArrow(frugal(run), schema), "runs")
    finer = materialize(_contents(runs, F.col("d"), F.col("several"), across), "contents")
    wanted = finer.join(_open_files(finer, across), "g").select("g", "c", "d", "several", "whole", "large")
    again = materialize(runs.select("g", "c", "bytes").join(wanted, ["g", "c"]).dropDuplicates(["g", "c"]).select("g", "c", "d", "several", "whole", "large", "bytes"), "contents")
    inner = _within(finer, again, unit, length, across, groups, grams[1:])
    placed = runs.select("pg", "pc", "g", "c", "a").join(inner, ["g", "c"])
    return found.unionAll(placed.select(F.col("pg").alias("g"), F.col("pc").alias("c"), F.col("a") + F.col("s"), F.col("a") + F.col("e"), "grp"))


def _found(docs: DataFrame, length: int, unit: str, across: bool, groups: bool) -> DataFrame:
    """did, th, s, e, grp: places of repeats, in symbols."""
    bounded_batches(docs.sparkSession)
    runs = materialize(_keyed(docs).mapInArrow(frugal(_runs(unit, length)), "did long, th long, g long, c long, a int, n int, multi boolean"), "runs")
    contents = materialize(_contents(runs, F.xxhash64("did", "th"), F.lit(False), across), "contents")
    wanted = contents.join(_open_files(contents, across), "g")
    requests = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("g", "c", "d", "several", "whole", "large", "a", "n")).alias("runs"))
    fetched = _squeezed(docs).join(requests, ["did", "th"]).select("packed", "runs").mapInArrow(frugal(_fetch(unit, length)), "g long, c long, d long, several boolean, whole boolean, large boolean, bytes binary")
    fetched = materialize(fetched.dropDuplicates(["g", "c"]), "contents")
    inside = _within(contents, fetched, unit, length, across, groups, [length // 2, length])
    return runs.select("did", "th", "g", "c", "a").join(inside, ["g", "c"]).select("did", "th", (F.col("a") + F.col("s")).alias("s"), (F.col("a") + F.col("e")).alias("e"), "grp")


def repeated_spans(docs: DataFrame, length: int = LENGTH, unit: str = "bytes", across: bool = False) -> DataFrame:
    """did, th, s, e: spans covered by a string of ``length`` symbols that starts anywhere else too.

    Spans of one document may overlap; together they are exactly the repeated
    symbols, bytes or words by ``unit``. With ``across`` the other place must lie in
    another document.
    """
    return _found(docs, length, unit, across, groups=False).select("did", "th", "s", "e")


def _joined(occurrences: DataFrame) -> DataFrame:
    """grp, length, did, th, start: groups of all files joined where they are pieces of one repeat.

    A group is told by its first occurrence and by how far all others lie from it,
    as two hashes of that set. Groups alike in this are stretches of one string at
    the same places, so those that touch are one longer repeat. Only hashes and
    places move, a row for each group; occurrences meet their group by a join.
    """
    first = occurrences.groupBy("grp", "length").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "start")).alias("at"))
    apart = F.col("start") - F.col("at.start")
    sets = [F.bit_xor(F.xxhash64(F.lit(seed), "did", "th", apart)).alias(f"set{seed}") for seed in (1, 2)]
    alike = ["did", "th", "n", "set1", "set2"]
    told = occurrences.join(first, ["grp", "length"]).groupBy("grp", "length", "n", "at").agg(*sets).select("grp", "length", "n", "set1", "set2", F.col("at.did").alias("did"), F.col("at.th").alias("th"), F.col("at.start").alias("begin"))
    told = materialize(told, "groups")
    order = Window.partitionBy(*alike).orderBy("begin", "length")
    reach = F.max(F.col("begin") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = told.withColumn("opens", F.coalesce((F.col("begin") > reach).cast("int"), F.lit(1)))
    placed = opened.withColumn("piece", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lead = F.min_by(F.struct("grp", "length"), F.struct("begin", "length")).alias("lead")
    whole = placed.groupBy(*alike, "piece").agg(F.count("*").alias("pieces"), F.min("begin").alias("begin"), F.max(F.col("begin") + F.col("length")).alias("end"), lead)
    size = (F.col("end") - F.col("begin")).alias("size")
    name = F.when(F.col("pieces") == 1, F.col("lead.grp")).otherwise(F.xxhash64("lead.grp", F.col("end") - F.col("begin"))).alias("name")
    longer = whole.select(F.col("lead.grp").alias("grp"), F.col("lead.length").alias("length"), name, size)
    return occurrences.join(longer, ["grp", "length"]).select(F.col("name").alias("grp"), F.col("size").alias("length"), "did", "th", "start")


def repeat_groups(docs: DataFrame, length: int = LENGTH, unit: str = "bytes", across: bool = False) -> DataFrame:
    """grp, length, doc_id, start: repeats with all their occurrences, a row for each.

    A group is a string, named by a hash, that stands at all the places listed and
    nowhere else. Groups of several files that lie at the same places one after
    another are joined to one, so a passage that some documents share is one group,
    however long. Where a part of a passage stands in further documents too, that part
    is a group of its own, with all its places, and the passage is put out in pieces
    around it. A null doc_id stays null.
    """
    found = _found(docs, length, unit, across, groups=True)
    occurrences = materialize(found.select("grp", (F.col("e") - F.col("s")).alias("length"), "did", "th", F.col("s").alias("start")).distinct(), "occurrences")
    did = F.when(F.col("did") != _NO_ID, F.col("did"))
    return _joined(occurrences).select("grp", "length", did.alias("doc_id"), "start")


def _by_document(spans: DataFrame, name: str) -> DataFrame:
    return spans.distinct().groupBy("did", "th").agg(F.collect_list(F.struct("s", "e")).alias(name))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans, in order."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["s"], s["e"]) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def cut(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left, the bytes removed and the maximal removed runs."""
    kept, removed, at, runs = [], 0, 0, merged(spans)
    for begin, end in runs:
        kept.append(text[at:begin])
        removed += end - begin
        at = end
    kept.append(text[at:])
    return b"".join(kept), removed, len(runs)


def cut_words(text: bytes, spans: list[dict]) -> bytes:
    """Without the words of the spans and the space after each run of them."""
    data = np.frombuffer(text, np.uint8)
    starts = np.append(word_spans(data, np.array([0, len(data)]))[0], len(data))
    return cut(text, [{"s": int(starts[a]), "e": int(starts[b])} for a, b in merged(spans)])[0]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """did, th, packed text, spans, passages in; what is left, how much went out and what the passages hold."""
    press = zstandard.ZstdDecompressor()
    names = ["doc_id", "th", "n_bytes", "n_removed", "n_spans", "n_passages", "n_passage_words", "kept"]

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row in batch.to_pylist():
            text = _opened(press, row["packed"])
            kept, removed, runs = cut(text, row["spans"] or [])
            passages = merged(row["passages"])
            yield (None if row["did"] == _NO_ID else row["did"], row["th"], len(text), removed, runs, len(passages), sum(b - a for a, b in passages), kept)

    for batch in batches:
        yield from _bounded(rows(batch), names, [pa.int64()] * 7 + [pa.binary()])


_SPAN_LIST = "array<struct<s:bigint,e:bigint>>"


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage_words: int | None = None) -> DataFrame:
    """doc_id, th, n_bytes, n_removed, n_spans, n_passages, n_passage_words, kept (binary): one row for each row of ``docs``.

    Each byte goes that is covered by a string of ``length`` bytes starting anywhere
    else in the corpus too, the same document included; overlaps count, and strings
    are judged on the input. n_spans counts maximal removed runs. With
    ``passage_words``, n_passages and n_passage_words count, by words, what is covered
    by so many words in a row that another document holds too; else they are 0. A
    null or short text keeps all its bytes; repeated rows are copies of each other
    and so lose theirs; a null doc_id stays null; other columns are ignored.
    """
    spans = _by_document(repeated_spans(docs, length), "spans")
    if passage_words:
        spans = spans.join(_by_document(repeated_spans(docs, passage_words, "words", across=True), "passages"), ["did", "th"], "full_outer")
    else:
        spans = spans.withColumn("passages", F.lit(None).cast(_SPAN_LIST))
    joined = _squeezed(docs).join(spans, ["did", "th"], "left").select("did", "th", "packed", "spans", "passages")
    return joined.mapInArrow(frugal(_cut), "doc_id long, th long, n_bytes long, n_removed long, n_spans long, n_passages long, n_passage_words long, kept binary")


def repeat_digests(docs: DataFrame, length: int = LENGTH, passage_words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``passage_words``, n_passages, n_passage_words."""
    more = ["n_passages", "n_passage_words"] if passage_words else []
    return remove_repeats(docs, length, passage_words).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *more)


def without_repeats(docs: DataFrame, length: int = LENGTH, unit: str = "bytes", across: bool = False) -> DataFrame:
    """``docs`` with ``text`` rid of what ``repeated_spans`` finds; other columns unchanged.

    Every occurrence goes, the first one too: what many texts share belongs to none
    of them. Of bytes, a character that lost some of its bytes goes whole; of words,
    the space after each removed run goes with it. Rows of one doc_id and text are
    alike, so each gets what is left of it; a text of which nothing was removed, or
    null, stays as it is.
    """
    spans = _by_document(repeated_spans(docs, length, unit, across), "spans")
    names = [c for c in docs.columns if c != "text"]

    def left(text: str, found: list[dict]) -> str:
        raw = text.encode()
        return (cut_words(raw, found) if unit == "words" else cut(raw, found)[0]).decode("utf-8", "ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [left(text, found) if found and text is not None else text for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.column(2).flatten()], names=["text", *names])

    # Other columns travel as one, so that their names can't clash with those of the join.
    did, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(did.alias("did"), F.xxhash64(text).alias("th"), "text", F.struct(*map(named, names)).alias("rest"))
    joined = keyed.join(spans, ["did", "th"], "left").select("text", "spans", "rest")
    fields = [StructField("text", StringType()), *(f for f in docs.schema if f.name != "text")]
    return joined.mapInArrow(frugal(run), StructType(fields)).select(*map(named, docs.columns))
