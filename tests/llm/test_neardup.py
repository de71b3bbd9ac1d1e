import re

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import neardup
from corpusloom.llm.components import connected_components
from corpusloom.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """component of each row by comparing every pair."""
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is not None and j is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(find(i) if i is not None and s else i)) for (i, _), s in zip(rows, sets))


def test_equals_brute_force(awkward):
    df, rows = awkward
    got = neardup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_first_stars_alone_may_miss_what_rare_shingles_find(spark):
    """Copies that link to their original only; it is the centre of few buckets."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(500, " ".join(base))]
    for i in range(120):
        t = list(base)
        for p in rng.choice(150, 4, replace=False):
            t[p] = f"x{i}_{p}"
        rows.append((i, " ".join(t)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted((str(k), str(v)) for k, v in got.items()) == sorted((i, c) for i, _, c in brute(rows))


def crowd_rows(rng, n, linked=6):
    """n documents that share one passage and little else, and some that are near copies of others."""
    passage = [f"p{i}" for i in range(80)]
    rows = [(i, [f"d{i}w{k}" for k in range(60)]) for i in range(n)]
    for i in range(linked):
        copy = list(rows[i * 7][1])
        copy[30] = "changed"
        rows.append((n + i, copy))
    return [(i, " ".join(own[:30] + passage + own[30:])) for i, own in rows]


def test_crowds_meet_by_rare_shingles_only(spark):
    """Buckets that a shared passage fills: as many candidates as links, not as pairs."""
    rng = np.random.default_rng(4)
    rows = crowd_rows(rng, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    crowd = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component"))
    pairs = {tuple(sorted((r.u, r.v))) for r in neardup.rare_pairs(crowd, docs).collect()}
    assert pairs == {(7 * i, 400 + i) for i in range(6)}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert sorted((str(k), str(v)) for k, v in got.items()) == sorted((i, c) for i, _, c in brute(rows))


def test_candidates_grow_with_the_members_of_unsettled_buckets(spark):
    """Many buckets of unlinked members that share a passage: no more candidates than links, here none."""
    rows = [(1000 * g + i, " ".join([*(f"g{g}i{i}w{k}" for k in range(40)), *(f"g{g}p{k}" for k in range(80))])) for g in range(5) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sketches = neardup.sketch_documents(docs)
    members = sketches.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    assert members.groupBy("key").count().agg(F.max("count")).first()[0] > 30
    alone = spark.createDataFrame([], "u long, component long")
    assert neardup._between_components(members, alone, sketches, docs).count() == 0


def test_rare_pairs_hold_every_link(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        t = list(base)
        for p in rng.choice(60, rng.integers(0, 12), replace=False):
            t[p] = f"x{rng.integers(0, 3)}_{p}"
        rows.append((i, " ".join(t[: rng.integers(3, 61)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = {tuple(sorted((r.u, r.v))) for r in neardup.rare_pairs(docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component")), docs).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert links and links <= pairs


def test_recall_on_short_documents(spark):
    """Links between documents of 5 to 30 words, where densified bins repeat few shingles."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        size = int(rng.integers(5, 31))
        own = [f"{i}w{k}" for k in range(size)]
        changed = list(own) if rng.random() < 0.3 else own[:-1] if size > 9 else own
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(changed))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [i for i in range(0, 1200, 2) if 100 * len(sets[i] & sets[i + 1]) >= 75 * len(sets[i] | sets[i + 1])]
    assert len(links) > 500 and all(got[i] == got[i + 1] == i for i in links)


def test_drop_keeps_columns_and_one_of_each_group(awkward, empty):
    df, rows = awkward
    kept = neardup.drop_near_duplicates(df.withColumn("key", F.lit(1)).withColumn("component", F.lit("x")))
    assert kept.columns == [*df.columns, "key", "component"]
    assert {r.doc_id for r in kept.collect()} == {int(i) for i, _, c in brute(rows) if i == c and i != "None"} | {None}
    assert neardup.near_duplicates(empty).count() == 0


def test_drop_keeps_one_of_repeated_rows_and_of_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (1, a.upper()), (2, a), (None, b), (None, b), (None, b + " tail"), (None, None), (None, None), (3, ""), (3, ""), (4, c), (4, a + " " + c), (None, c), (5, "x y z")]
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted((str(r.doc_id), (r.text or "-").lower()[:2]) for r in kept)
    assert [g for g in got if g[0] == "None"] == [("None", "-"), ("None", "-"), ("None", "b0")]
    assert [g for g in got if g[0] != "None"] == [("1", "a0"), ("3", "-"), ("3", "-"), ("4", "a0"), ("4", "c0"), ("5", "x ")]


def test_densified_bins_are_filled_and_alike_for_equal_sets():
    sets = [np.sort(np.random.default_rng(i).integers(0, 2**64, n, dtype=np.uint64)) for i, n in ((1, 1), (2, 3), (3, 400), (2, 3))]
    s = neardup.signatures(sets)
    assert np.isin(s[0], sets[0]).all() and np.isin(s[1], sets[1]).all() and (s[1] == s[3]).all()
    assert shingle_sets(np.zeros(0, np.uint8), np.zeros(3, np.int64))[0].size == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7), (None, 3)] + [(200, i) for i in range(201, 260)]
    got = {r.u: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90} | {i: 200 for i in range(200, 260)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
