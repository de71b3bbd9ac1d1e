import random
from hashlib import sha256
from zlib import crc32

import pytest
from compare import SF, same
from pyspark.sql import functions as F

from corpusloom.llm import merkle
from corpusloom.llm.oracles import oracle_sql
from corpusloom.llm.queries import queries


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, source, lang, n_chars, text = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(nodes):
    """The root and every leaf's list of (left, right) siblings, by the definition."""
    ways, at, below = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(below) > 1:
        runs = [below[i : i + 8] for i in range(0, len(below), 8)]
        for i, k in enumerate(at):
            ways[i].append(("".join(runs[k // 8][: k % 8]), "".join(runs[k // 8][k % 8 + 1 :])))
        at, below = [k // 8 for k in at], [digest(*run) for run in runs]
    return below[0], ways


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row[2], []).append(row)
    langs = sorted(by, key=lambda x: b"" if x is None else b"v" + x.encode())
    trees, found = {}, []
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = climb([leaf_of(r) for r in by[lang]])
    root, tops = climb([trees[x][0] for x in langs])
    for lang, top in zip(langs, tops, strict=True):
        subroot, ways = trees[lang]
        for row, way in zip(by[lang], ways, strict=True):
            leaf, whole = leaf_of(row), way + top
            node = leaf
            if row[0] is not None and crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                node = leaf_of((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for left, right in whole:
                node = digest(left, node, right)
            found.append((row[0], leaf, subroot, root, digest(*(a + b for a, b in whole)), node, node == root))
    return sorted(found, key=repr)


def table(spark, rows):
    clashing = [(r[3], r[1], r[4], "x", r[2], r[0], 1, 2) for r in rows]
    kinds = "n_chars long, source string, text string, hash string, lang string, doc_id long, pos int, `a.b` int"
    return spark.createDataFrame(clashing, kinds).repartition(5)


def some_rows(n, langs, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcXYZé日 ") for _ in range(rng.randint(0, 12)))
    rows = [(i, rng.choice([None, "s", "S1"]), langs[min(int(rng.expovariate(1)), len(langs) - 1)], rng.choice([None, 5]), rng.choice([None, "", word(), word() * 50])) for i in range(n)]
    return rows + [(1, "s", langs[0], 1, "A b")] * 3 + [(1, "s", langs[0], 1, "A c"), (None, None, None, None, None), (None, "s", "", 2, "É")]


@pytest.mark.parametrize("n,langs", [(1200, ["en", None, "fr", "é", "", "Z"]), (700, ["en"] + [f"l{i}" for i in range(70)]), (90, [None]), (0, ["en"])])
def test_equals_brute_force(spark, n, langs):
    rows = some_rows(n, langs)
    assert sorted(map(tuple, merkle.manifest_digests(table(spark, rows)).collect()), key=repr) == brute(rows)
    assert n == 0 or not all(r[-1] for r in brute(rows))


def test_one_row_and_none(spark):
    one = [(7, None, None, None, "AB")]
    assert list(map(tuple, merkle.manifest_digests(table(spark, one)).collect())) == brute(one)
    nothing = merkle.build_manifest(table(spark, one).where("false"))
    assert nothing.proofs.count() == nothing.nodes.count() == nothing.root.count() == 0


def test_versions_share_what_they_do_not_copy(spark):
    rows = some_rows(900, ["en", "fr"])
    docs = table(spark, rows)
    manifest = merkle.build_manifest(docs, tampered={"text": merkle.lowered(docs["text"])}, where=merkle.is_tampered(docs["doc_id"]))
    nodes = {(r.tree, r.level, r.pos): r.hash for r in manifest.nodes.collect()}
    leaves = {(r.tree, r.pos): r.leaf for r in manifest.leaves.collect()}
    for tree in {t for t, _ in leaves}:
        n = sum(t == tree for t, _ in leaves)
        level, width = 1, -(-n // 8)
        while n > 1:  # every inner node is there once, made of the ones below it
            below = leaves if level == 1 else {(t, p): h for (t, lv, p), h in nodes.items() if lv == level - 1}
            for p in range(width):
                assert nodes[tree, level, p] == digest(*(below[tree, q] for q in range(8 * p, 8 * p + 8) if (tree, q) in below))
            if width == 1:
                break
            level, width = level + 1, -(-width // 8)
    alone = {t for t, _ in leaves} - {t for t, _ in leaves if (t, 1) in leaves}
    for v in merkle.versions(manifest).where(~F.col("tree").isin(*alone)).collect():
        own = {(v.tree, k, v.pos // 8**k): h for k, h in enumerate(v.copies, 1)}
        run = [v.leaf if q == v.pos else leaves.get((v.tree, q)) for q in range(v.pos // 8 * 8, v.pos // 8 * 8 + 8)]
        assert own[v.tree, 1, v.pos // 8] == digest(*(h for h in run if h))
        assert (own[v.tree, 1, v.pos // 8] == nodes[v.tree, 1, v.pos // 8]) == (v.leaf == leaves[v.tree, v.pos])


def test_query_matches_sql(spark):
    same(spark, SF, queries()["op11_merkle_manifest"], oracle_sql()["op11_merkle_manifest"])
