"""Near-duplicate documents by MinHash with confirmed links.

One-permutation hashing: a document's shingle hashes fall into ``BINS`` bins by
their top bits and the least of each bin is kept; an empty bin takes the value of
the first filled bin on a fixed random probe walk (optimal densification). Runs
of ``ROWS`` bins make the banded buckets. In a bucket a star is drawn: one centre
is compared with all other members, never all members with each other. Every
candidate is compared by parity sketches, then confirmed on the full shingle sets:
each shingle turns one of ``BITS`` bits over, so two sketches differ in at most as
many bits as the sets differ in shingles, and a link is never left out.

Members of a bucket that still lie in different components may have links that the
first star missed. Their candidates are those that share a rare shingle, as every
link must; so a passage that countless documents share makes no pairs of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import named
from corpusloom.llm import _bytes as B
from corpusloom.llm._shared import bounded_batches, materialize
from corpusloom.llm.components import connected_components
from corpusloom.llm.shingles import shingle_sets

BINS = 128
ROWS = 4
BANDS = BINS // ROWS
#: Of the parity sketch.
BITS = 1024
WORDS = BITS // 64
#: Members of a star that one copy of its centre is compared with.
STAR = 512
#: A link needs 100 * intersection >= 75 * union.
PERCENT = 75
_TOP = np.uint64(57)  # shift that leaves the number of one of 128 bins


def _walk(attempt: int) -> np.ndarray:
    """The bin that each empty bin looks at in its nth attempt."""
    seed = B.mix64(np.array([attempt], np.uint64) * B._ODD)
    return (B.mix64(np.arange(BINS, dtype=np.uint64) + seed) >> _TOP).astype(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS minima for each set; rows of empty sets are 0."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    if not sizes.sum():
        return out
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    bins = (values >> _TOP).astype(np.int64)
    cell = owner * BINS + bins
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # sets are sorted, so the least of a bin comes first
    out.ravel()[cell[first]] = values[first]
    filled.ravel()[cell[first]] = True
    row, col = np.nonzero(~filled & (sizes > 0)[:, None])
    attempt = 0
    while len(row):
        look = _walk(attempt)[col]
        hit = filled[row, look]
        out[row[hit], col[hit]] = out[row[hit], look[hit]]
        row, col = row[~hit], col[~hit]
        attempt += 1
    return out


_BAND = B.mix64(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    mixed = (B.mix64(signature) * _BAND).reshape(len(signature), BANDS, ROWS).sum(axis=2, dtype=np.uint64)
    return B.mix64(mixed).view(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """The parity sketch of each set, a row of WORDS longs."""
    cells = [np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1 for s in sets]
    return np.packbits(np.array(cells, np.uint8).reshape(-1, BITS), axis=1).view(np.int64)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), *((f"bits{i}", pa.int64()) for i in range(WORDS))])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = B.text_buffers(batch.column(1))
        for a, b, part, off in B.chunks(data, offsets):
            sets = shingle_sets(part, off)
            signature = signatures(sets)
            keys = band_keys(signature)
            digest = [np.array([len(s), s.sum(dtype=np.uint64), B.mix64(s).sum(dtype=np.uint64)], np.uint64).tobytes() for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            low = parities(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), lists, *(pa.array(np.ascontiguousarray(low[:, i])) for i in range(WORDS))],
                schema=_SKETCH,
            )


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, band keys, parity sketch."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_sketch, "doc_id long, n_shingles long, digest binary, bands array<long>, " + ", ".join(f"bits{i} long" for i in range(WORDS)))


def linked(mine: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold; an empty one never does."""
    small, large = sorted((len(mine), len(other)))
    if not small or 100 * small < PERCENT * large:
        return False
    both = len(np.intersect1d(mine, other, assume_unique=True))
    return 100 * both >= PERCENT * (len(mine) + len(other) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, part, v, text in, the centre's text (v null) before those of its members; linked u, v out."""
    now, centres = None, []
    for batch in batches:
        us, parts, vs = (batch.column(i).to_pylist() for i in range(3))
        data, offsets = B.text_buffers(batch.column(3))
        out: list[tuple[int, int]] = []
        for a, b, part, off in B.chunks(data, offsets):
            for i, one in zip(range(a, b), shingle_sets(part, off), strict=True):
                if (us[i], parts[i]) != now:
                    now, centres = (us[i], parts[i]), []
                if vs[i] is None:  # several where rows of one doc_id have different texts
                    if not any(np.array_equal(c, one) for c in centres):
                        centres.append(one)
                elif any(linked(c, one) for c in centres):
                    out.append((us[i], vs[i]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["u", "v"])


def confirm_links(pairs: DataFrame, docs: DataFrame, many: bool = False) -> DataFrame:
    """Those of the pairs (u, v) whose full shingle sets reach the threshold.

    u is the centre of a star. A text goes once to each star that it is in; the
    centre's goes once to each STAR of its members, which is a task's share. Where
    ``many`` pairs are in store, in proportion to the documents, texts meet them by a
    merge join at any size; few may be broadcast.
    """
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    members = pairs.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"), "v", F.col("v").alias("id"))
    centres = parts.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("v"), F.col("u").alias("id"))
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    wanted = members.unionByName(centres)
    rows = (wanted.hint("merge") if many else wanted).join(texts, "id").select("u", "part", "v", "text")
    return rows.repartition("u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v")).mapInArrow(_confirm, "u long, v long")


def _once(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once, in the direction whose centre is smaller."""
    low, high = F.least("u", "v").alias("low"), F.greatest("u", "v").alias("high")
    kept = pairs.where("u <> v").groupBy(low, high).agg(F.min("u").alias("u"))
    return kept.select("u", F.when(F.col("u") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("v"))


_BITS = [f"bits{i}" for i in range(WORDS)]


def _may_link(n: Column, m: Column, differ: Column) -> Column:
    """100 i >= P u with i + d = u, i + u = n + m, for d at least ``differ``, the size of the difference."""
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (n + m)


def _allowed(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sizes and parity sketches allow a link."""
    one = sketches.select(F.col("doc_id").alias("u"), F.col("n_shingles").alias("n"), *_BITS)
    other = sketches.select(F.col("doc_id").alias("v"), F.col("n_shingles").alias("m"), *(F.col(b).alias(f"o_{b}") for b in _BITS))
    differ = sum(F.bit_count(F.col(b).bitwiseXOR(F.col(f"o_{b}"))) for b in _BITS)
    return pairs.join(one, "u").join(other, "v").where(_may_link(F.col("n"), F.col("m"), differ)).select("u", "v").distinct()


def _first_stars(members: DataFrame) -> DataFrame:
    """The centre of each bucket with its other members.

    The centre has the least id after XOR with the bucket's key, so a document is
    the centre of some of its buckets but not of all.
    """
    centres = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("id").bitwiseXOR(F.col("key"))).alias("c")).where("n > 1")
    stars = members.join(centres.select("key", F.col("c").bitwiseXOR(F.col("key")).alias("c")), "key")
    return _once(stars.select(F.col("c").alias("u"), F.col("id").alias("v")))


def _between_components(members: DataFrame, components: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates among the members of all buckets in which several components meet.

    What lies in one component already needs no comparison, and members of a bucket
    are not compared with each other: rare shingles find the candidates.
    """
    placed = members.join(components.withColumnRenamed("u", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    unsettled = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    crowd = materialize(placed.join(unsettled, "key", "left_semi").select("id", "component").distinct(), "crowd")
    return _once(_allowed(rare_pairs(crowd, docs), sketches))


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, component, text in; a row for each distinct shingle out."""
    for batch in batches:
        data, offsets = B.text_buffers(batch.column(2))
        for a, b, part, off in B.chunks(data, offsets):
            sets = shingle_sets(part, off)
            size = np.array([len(s) for s in sets])
            own = [np.repeat(batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False), size) for i in range(2)]
            digest = np.repeat(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64), size)
            yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(digest), pa.array(np.repeat(size, size)), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "component", "digest", "n", "h"])


def rare_pairs(crowd: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (u, v) of the documents (id, component) that share a rare shingle, which every link does.

    Shingles are ordered by the number of documents with them. Two sets that reach
    the threshold share one of their n - ceil(n P / 100) + 1 rarest; so what a whole
    crowd shares makes no pair. Only documents of different components and fitting
    sizes meet, and only where so many shingles follow the shared one in both orders
    that, were it the first they share, they could still reach the threshold.
    """
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    shingles = materialize(crowd.join(texts, "id").select("id", "component", "text").mapInArrow(_shingle_rows, "id long, component long, digest long, n long, h long").distinct(), "shingles")
    often = shingles.groupBy("h").agg(F.count("*").alias("often"), F.min("component").alias("a"), F.max("component").alias("b"))
    # What one component has for itself can't make a pair, but has its place in the order.
    order = Window.partitionBy("id", "component", "digest", "n").orderBy("often", "h")
    ranked = shingles.join(often, "h").withColumn("place", F.row_number().over(order))
    places = ranked.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1) & (F.col("a") != F.col("b")))
    places = places.select("id", "component", "n", "h", (F.col("n") - F.col("place") + 1).alias("left"))
    places = materialize(places, "rare")
    other = places.select(F.col("id").alias("v"), F.col("component").alias("of"), F.col("n").alias("m"), "h", F.col("left").alias("m_left"))
    fits = ((100 + PERCENT) * F.least("left", "m_left") >= PERCENT * (F.col("n") + F.col("m"))) & (F.col("component") < F.col("of"))
    return places.join(other, "h").where(fits).select(F.col("id").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs`` (doc_id, text, ...).

    component_id is the smallest doc_id reachable over links with
    100 * intersection >= 75 * union of the distinct five-word shingles; kept is
    doc_id = component_id. Texts with the same set are one node at first, so a
    group of copies costs one row in every bucket. A null or empty text has no
    shingles and no links. Rows of one doc_id are one document and share a
    component; a null doc_id has no links, a null component and is kept. An empty
    table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    sketches = materialize(sketch_documents(docs), "sketches")
    nodes = sketches.where("n_shingles > 0 and doc_id is not null")
    sets = materialize(nodes.groupBy("digest").agg(F.min("doc_id").alias("id")), "sets")
    members = nodes.join(sets.select(F.col("id").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    members = materialize(members.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")), "members")
    same_id = nodes.join(sets, "digest").groupBy(F.col("doc_id").alias("u")).agg(F.min("id").alias("v"), F.max("id").alias("w")).where("v <> w")
    sketched = nodes.dropDuplicates(["doc_id", "digest"])
    known = materialize(_allowed(_first_stars(members), sketched), "pairs")
    links = materialize(confirm_links(known, docs, many=True).unionAll(same_id.select(F.col("v").alias("u"), F.col("w").alias("v"))), "links")
    components = connected_components(links)
    either = known.unionAll(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
    more = materialize(_between_components(members, components, sketched, docs).join(either, ["u", "v"], "left_anti"), "pairs")
    found = materialize(confirm_links(more, docs), "links")
    if found.head(1):
        components = connected_components(links.unionAll(found))
    out = sketches.select("doc_id", "n_shingles", "digest").join(sets, "digest", "left").join(components.withColumnRenamed("u", "id"), "id", "left")
    linked = F.col("n_shingles") > 0
    component = F.when(linked & F.col("doc_id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _node(doc_id: Column, text: Column) -> Column:
    """The doc_id, or for a null one a number from 2**62 on that depends on the text."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))


def _words(text: Column) -> Column:
    """A digest of the words as shingles see them, null where there are none."""
    plain = F.trim(F.regexp_replace(F.translate(text, ascii_uppercase, ascii_lowercase), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain != "", F.sha2(plain.cast("binary"), 256))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays, all columns unchanged.

    Of rows with one doc_id and the same words one stays; rows with a null doc_id
    are documents of their own here, so their copies link. Rows without words stay.
    Only rows of repeated documents move for that, reduced in each task first.
    """
    row = F.struct(*(F.col(named(c)) for c in docs.columns))  # as one, so that no name can clash
    keyed = docs.select(_node(F.col("doc_id"), F.col("text")).alias("node"), row.alias("row"))
    found = near_duplicates(keyed.select(F.col("node").alias("doc_id"), "row.text"))
    marks = found.groupBy(F.col("doc_id").alias("node")).agg(F.bool_and("kept").alias("kept"), F.count_if(F.col("n_shingles") > 0).alias("n")).where("not kept or n > 1")
    marks = materialize(marks, "marks")
    single = keyed.join(marks, "node", "left_anti").select("row.*")
    again = keyed.join(marks.where("kept").select("node"), "node", "left_semi").select("node", "row", _words(F.col("row.text")).alias("words"))
    one = again.where("words is not null").dropDuplicates(["node", "words"])
    return single.unionAll(one.select("row.*")).unionAll(again.where("words is null").select("row.*"))
