"""A Merkle manifest of a dataset: one tree for each language, one over their roots, versions by path copying.

Rows become leaves by built-in functions; what moves after that are hashes. Leaves
are numbered in their tree and taken in aligned blocks of FAN ** LEVELS: a task
hashes a block up to its one node, and the nodes of all blocks are the leaves of
the next pass. On the way down each block gets the siblings that lie above it.

The tree is persistent: a changed leaf makes a version, which copies the leaf's
ancestors and shares every other node with the tree it came from. A block's task
copies the ancestors inside the block and carries on with those above it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import bounded_batches, materialize
from corpusloom.operators.index import global_index

FAN = 8
#: Levels of one block; its leaves, FAN ** LEVELS at most, are one task's work at a time.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "tree string, level int, pos long, n long, hash string"
_PATH = "array<struct<l:string,r:string>>"
_PATHS = f"tree string, pos long, subroot string, path {_PATH}"
_PROOFS = "tree string, pos long, doc_id long, leaf string, tampered string, subroot string, proof_sha256 string, copies array<string>"


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_hash(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each as its bytes in UTF-8, a colon and its value, or - if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case; nothing else changes."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def is_tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def depth(n: int) -> int:
    """How often n nodes are taken FAN at a time until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _depth(n: Column) -> Column:
    return sum(((n > FAN**k).cast("int") for k in range(21)), F.lit(0))


def _risen(hashes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block, level by level."""
    out = [hashes]
    for _ in range(levels):
        below = out[-1]
        out.append([H(*below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return out


def _siblings(block: list[list[str]], i: int) -> list[tuple[str, str]]:
    """What stands left and right of leaf i's ancestors in their runs, below the block's one node."""
    out = []
    for nodes in block[:-1]:
        first = i - i % FAN
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + FAN])))
        i //= FAN
    return out


def _in_order(table: pa.Table) -> dict[str, list]:
    return table.sort_by("pos").to_pydict()


def _block(number: Column) -> Column:
    """A block's name. One column, so that blocks of one tree are dealt out even where its rows lie together."""
    return F.concat(number.cast("string"), F.lit(":"), F.col("tree"))


def _by_block(nodes: DataFrame):
    return nodes.withColumn("block", _block(F.shiftright("pos", 3 * LEVELS))).groupBy("block")


def _by_root(above: DataFrame):
    """Paths above blocks, each with the name of its block."""
    return above.withColumn("block", _block(F.col("pos"))).groupBy("block")


def _raise(level: int):
    def run(table: pa.Table) -> pa.Table:
        rows = _in_order(table)
        n, at = rows["n"][0], rows["pos"][0]
        out: dict[str, list] = {c: [] for c in ("tree", "level", "pos", "n", "hash")}
        for k, hashes in enumerate(_risen(rows["hash"], min(LEVELS, depth(n)))[1:], 1):
            n, at = -(-n // FAN), at // FAN
            out["tree"] += rows["tree"][:1] * len(hashes)
            out["level"] += [level + k] * len(hashes)
            out["pos"] += range(at, at + len(hashes))
            out["n"] += [n] * len(hashes)
            out["hash"] += hashes
        return pa.table(out, schema=pa.schema([("tree", pa.string()), ("level", pa.int32()), ("pos", pa.int64()), ("n", pa.int64()), ("hash", pa.string())]))

    return run


def _rows(names: str, rows: list[tuple]) -> pa.Table:
    path = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
    kinds = {"pos": pa.int64(), "doc_id": pa.int64(), "path": path, "copies": pa.list_(pa.string())}
    columns = list(zip(*rows, strict=True)) or [()] * len(names.split())
    return pa.table({c: pa.array(v, kinds.get(c, pa.string())) for c, v in zip(names.split(), columns, strict=True)})


def _block_of(nodes: dict[str, list]) -> list[list[str]]:
    return _risen(nodes["hash"], min(LEVELS, depth(nodes["n"][0])))


def _descend(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The path of each node: siblings inside its block, then those above."""
    rows, up = _in_order(nodes), above.to_pylist()[0]
    block, upper = _block_of(rows), up["path"]
    return _rows("tree pos subroot path", [(up["tree"], pos, up["subroot"], [{"l": l, "r": r} for l, r in _siblings(block, i)] + upper) for i, pos in enumerate(rows["pos"])])


def _prove(leaves: pa.Table, above: pa.Table) -> pa.Table:
    """Each leaf's proof, and its version: the copies of its ancestors, from its parent to the root."""
    rows, up = _in_order(leaves.rename_columns(["hash" if c == "leaf" else c for c in leaves.column_names])), above.to_pylist()[0]
    block, upper = _block_of(rows), [(x["l"], x["r"]) for x in up["path"]]
    above_all = "".join(l + r for l, r in upper)
    out = []
    for i, (pos, doc_id, leaf, tampered) in enumerate(zip(rows["pos"], rows["doc_id"], rows["hash"], rows["tampered"], strict=True)):
        inner = _siblings(block, i)
        node, copies = leaf if tampered is None else tampered, []
        for left, right in inner + upper:
            node = H(left, node, right)
            copies.append(node)
        out.append((up["tree"], pos, doc_id, leaf, tampered, up["subroot"], H(*(l + r for l, r in inner), above_all), copies))
    return _rows("tree pos doc_id leaf tampered subroot proof_sha256 copies", out)


def grow(leaves: DataFrame) -> list[DataFrame]:
    """The inner nodes above ``leaves`` (tree, pos, n, hash): tree, level, pos, n, hash, a table for each pass.

    n is the number of a tree's nodes at a level. Each pass has a block for FAN **
    LEVELS nodes of the one before, so there are few.
    """
    passes, level = [], 0
    now = leaves.where("n > 1")
    while not now.isEmpty():
        made = materialize(_by_block(now.select("tree", "pos", "n", "hash")).applyInArrow(_raise(level), _NODES), "nodes")
        passes.append(made)
        level += LEVELS
        now = made.where((F.col("level") == level) & (F.col("n") > 1))
    return passes


def _paths_above(passes: list[DataFrame], roots: DataFrame) -> list[DataFrame]:
    """For each pass the paths of its blocks' nodes: tree, pos, subroot, path.

    ``roots`` has tree, n (its leaves), subroot and the path above each tree's root.
    """
    ends = roots.withColumn("pass", F.greatest(F.ceil(_depth(F.col("n")) / LEVELS) - 1, F.lit(0)))
    most = max(len(passes), 1)
    above: list[DataFrame] = [None] * most
    below = None
    for p in reversed(range(most)):
        own = ends.where(F.col("pass") == p).select("tree", F.lit(0).cast("long").alias("pos"), "subroot", "path")
        above[p] = own if below is None else own.unionByName(below)
        if p:
            entries = passes[p - 1].where((F.col("level") == p * LEVELS) & (F.col("n") > 1)).select("tree", "pos", "n", "hash")
            below = materialize(_by_block(entries).cogroup(_by_root(above[p])).applyInArrow(_descend_keyed, _PATHS), "paths")
    return above


def _descend_keyed(nodes: pa.Table, above: pa.Table) -> pa.Table:
    return _descend(nodes.drop_columns(["block"]), above.drop_columns(["block"]))


def _prove_keyed(leaves: pa.Table, above: pa.Table) -> pa.Table:
    return _prove(leaves.drop_columns(["block"]), above.drop_columns(["block"]))


@dataclass
class Manifest:
    """leaves: tree, pos, n, doc_id, leaf, tampered; nodes: the inner nodes of all trees; root: one row;
    proofs: a row for each leaf with its proof and the nodes that its version copies."""

    leaves: DataFrame
    nodes: DataFrame
    root: DataFrame
    proofs: DataFrame


def build_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, tampered: dict[str, Column] | None = None, where: Column | None = None) -> Manifest:
    """The trees over ``docs`` and a version for each row that ``where`` holds for, its fields replaced by ``tampered``.

    A tree holds one lang; trees stand in the order of lang, null first, by bytes.
    Its leaves ascend by doc_id, a null one first; rows of one doc_id ascend by leaf,
    so that repeated rows have the same result in any order. A field that is null is
    hashed as such, an empty text as one of no bytes. Columns that are no fields are
    not looked at. An empty table has no leaf and no root. Texts are read once.
    """
    bounded_batches(docs.sparkSession)
    of = {c: F.col(f"`{c}`") for c in fields}
    changed = leaf_hash([(tampered or {}).get(c, of[c]) for c in fields])
    # "n" before every "v...": a null language is the first tree and no language's name.
    tree = F.coalesce(F.concat(F.lit("v"), F.col("lang")), F.lit("n"))
    leaves = docs.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(list(of.values())).alias("leaf"), F.when(where if where is not None else F.lit(False), changed).alias("tampered")
    )
    placed = global_index(materialize(leaves, "leaves"), ["tree", "doc_id", "leaf"], "at", start=0)
    trees = placed.groupBy("tree").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    placed = placed.join(trees, "tree").select("tree", (F.col("at") - F.col("first")).alias("pos"), "n", "doc_id", "leaf", "tampered")
    passes = grow(placed.select("tree", "pos", "n", F.col("leaf").alias("hash")))

    nodes = None
    for made in passes:
        nodes = made if nodes is None else nodes.unionByName(made)
    subroots = placed.where("n = 1").select("tree", F.col("leaf").alias("hash"))
    if nodes is not None:
        subroots = subroots.unionByName(nodes.where("n = 1").select("tree", "hash"))
    tops = global_index(subroots.join(trees.select("tree", F.col("n").alias("leaves")), "tree"), ["tree"], "pos", start=0)
    tops = materialize(tops.crossJoin(F.broadcast(tops.agg(F.count("*").alias("n")))), "subroots")  # one row
    over = tops.select(F.lit("").alias("tree"), "pos", "n", "hash")
    upper = grow(over)
    root = over.where("n = 1").select("hash")
    for made in upper:
        root = root.unionByName(made.where("n = 1").select("hash"))
        nodes = made if nodes is None else nodes.unionByName(made)
    root = root.withColumnRenamed("hash", "root")

    n_trees = over.count()
    crown = docs.sparkSession.createDataFrame([("", n_trees, "", [])] * (n_trees > 0), f"tree string, n long, subroot string, path {_PATH}")
    above = _paths_above(upper, crown)[0]
    ways = _by_block(over).cogroup(_by_root(above)).applyInArrow(_descend_keyed, _PATHS)
    roots = tops.select("pos", F.col("tree").alias("name"), "leaves", "hash").join(ways.select("pos", "path"), "pos")
    roots = materialize(roots.select(F.col("name").alias("tree"), F.col("leaves").alias("n"), F.col("hash").alias("subroot"), "path"), "roots")
    above = _paths_above(passes, roots)[0]
    proofs = _by_block(placed).cogroup(_by_root(above)).applyInArrow(_prove_keyed, _PROOFS)
    nodes = nodes if nodes is not None else docs.sparkSession.createDataFrame([], _NODES)
    return Manifest(placed, nodes, root, proofs)


def versions(manifest: Manifest) -> DataFrame:
    """tree, pos, doc_id, leaf and copies of each version: all its nodes that are not the manifest's own."""
    return manifest.proofs.where("tampered is not null").select("tree", "pos", "doc_id", F.col("tampered").alias("leaf"), "copies")


def manifest_digests(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row, A-Z of every third text lower-cased in its version."""
    manifest = build_manifest(docs, tampered={"text": lowered(F.col("text"))}, where=is_tampered(F.col("doc_id")))
    folded = F.coalesce(F.try_element_at("copies", F.lit(-1)), "tampered", "leaf")
    found = manifest.proofs.select("doc_id", "leaf", "subroot", "proof_sha256", folded.alias("folded_root")).crossJoin(F.broadcast(manifest.root))  # one row
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
