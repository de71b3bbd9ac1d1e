import hashlib
import random
import re

import numpy as np
import pytest
from conftest_llm import words

from corpusloom.llm import repeats


def brute(rows, length):
    places = {}
    raw = [(t or "").encode() for _, t in rows]
    for k, b in enumerate(raw):
        for p in range(len(b) - length + 1):
            places.setdefault(b[p : p + length], []).append((k, p))
    gone = [bytearray(len(b)) for b in raw]
    for found in places.values():
        if len(found) > 1:
            for k, p in found:
                gone[k][p : p + length] = b"\1" * length
    return sorted(
        (str(i), len(b), sum(g), sum(1 for j in range(len(g)) if g[j] and not (j and g[j - 1])), hashlib.sha256(bytes(x for x, m in zip(b, g) if not m)).hexdigest())
        for (i, _), b, g in zip(rows, raw, gone)
    )


@pytest.fixture(scope="module")
def shared(spark):
    rng = random.Random(3)
    passages = [words(rng, n) for n in (140, 80, 90)]
    rows = [(i, words(rng, rng.randint(0, 60)) + rng.choice(passages)[rng.randint(0, 30) :] + words(rng, rng.randint(0, 40)) + (rng.choice(passages) if i % 3 else "")) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 1000), (103, "ab" * 600), (104, "abc" * 133 + "x"), (105, rows[3][1]), (105, rows[3][1]), (None, rows[5][1]), (None, "zz" * 700), (107, "a" * 399), (108, "a" * 400), (109, "é" * 300)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows


@pytest.mark.parametrize("largest", [repeats.LARGEST_FILE, 3, 0])
def test_equals_brute_force(shared, largest, monkeypatch):
    df, rows = shared
    monkeypatch.setattr(repeats, "LARGEST_FILE", largest)
    assert sorted((str(r[0]), *r[1:]) for r in repeats.repeat_digests(df).collect()) == brute(rows, 400)


@pytest.mark.parametrize("largest", [repeats.LARGEST_FILE, 3])
def test_groups_hold_all_occurrences(shared, largest, monkeypatch):
    """Each group is one string at each of its places, and together they cover what the spans cover."""
    df, rows = shared
    monkeypatch.setattr(repeats, "LARGEST_FILE", largest)
    texts = {}
    for i, t in rows:
        if i != 105 and i is not None:
            texts[i] = (t or "").encode()
    groups = {}
    for r in repeats.repeat_groups(df).collect():
        groups.setdefault((r.grp, r.length), set()).add((r.doc_id, r.start))
    covered = {i: bytearray(len(b)) for i, b in texts.items()}
    for (_, n), places in groups.items():
        strings = {texts[i][s : s + n] for i, s in places if i in texts}
        assert n >= 400 and len(places) > 1 and len(strings) <= 1
        for string in strings:
            everywhere = {(i, p) for i, b in texts.items() for p in range(len(b) - n + 1) if b[p : p + n] == string}
            assert largest == 3 or {x for x in places if x[0] in texts} == everywhere
        for i, s in places:
            if i in texts:
                covered[i][s : s + n] = b"\1" * n
    removed = {i: n for i, _, n, *_ in brute(rows, 400)}
    assert all(sum(c) == removed[str(i)] for i, c in covered.items())


@pytest.mark.parametrize("largest", [repeats.LARGEST_FILE, 1, 0])
def test_a_passage_is_one_group_however_it_was_filed(spark, largest, monkeypatch):
    monkeypatch.setattr(repeats, "LARGEST_FILE", largest)
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    long, other = letters(5000), letters(1200)
    rows = [(1, "q" + long + "r" + letters(300)), (2, letters(77) + "s" + long + "t"), (3, "u" + other + "v" + letters(40)), (4, letters(9) + "w" + other), (5, other + "x" + letters(50) + "y" + long[:399]), (6, letters(900))]
    found = {}
    for r in repeats.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        found.setdefault((r.grp, r.length), set()).add((r.doc_id, r.start))
    assert sorted((n, sorted(places)) for (_, n), places in found.items()) == [(1200, [(3, 1), (4, 10), (5, 0)]), (5000, [(1, 1), (2, 78)])]


def brute_words(rows, length):
    """Words of each row in a stretch of ``length`` words that another (doc_id, text) holds too."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    holders = {}
    for (i, t), w in zip(rows, split):
        for p in range(len(w) - length + 1):
            holders.setdefault(tuple(w[p : p + length]), set()).add((i, t))
    gone = [[False] * len(w) for w in split]
    for w, g in zip(split, gone):
        for p in range(len(w) - length + 1):
            if len(holders[tuple(w[p : p + length])]) > 1:
                g[p : p + length] = [True] * length
    return split, gone


@pytest.mark.parametrize("largest", [repeats.LARGEST_FILE, 1])
def test_passages_of_words_between_otherwise_different_documents(spark, largest, monkeypatch):
    """Planted passages of 50 to 60 words go; 49 words stay, and so does what repeats inside one document only."""
    monkeypatch.setattr(repeats, "LARGEST_FILE", largest)
    rng = random.Random(5)
    planted = [words(rng, n) for n in range(49, 61)]
    rows = [(i, f"{words(rng, rng.randint(5, 90))} {planted[i % 12]}\n {words(rng, rng.randint(5, 90))}") for i in range(48)]
    rows += [(100 + i, words(rng, 150)) for i in range(20)] + [(200, f"{planted[0]} end"), (201, " ".join([words(rng, 60)] * 3)), (202, planted[5]), (203, None), (204, ""), (205, rows[3][1]), (206, rows[3][1]), (206, rows[3][1]), (207, "a " * 700), (208, "a " * 90)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, th string, __spans int").repartition(4)
    split, gone = brute_words(rows, 50)
    want = sorted((str(i), [x for x, m in zip(w, g) if not m]) for (i, _), w, g in zip(rows, split, gone))
    left = repeats.without_repeats(df, 50, "words", across=True)
    assert left.columns == df.columns
    got = left.collect()
    assert sorted((str(r.doc_id), (r.text or "").split()) for r in got) == want
    kept = {r.doc_id: r.text for r in got}
    assert all(kept[i] == t for i, t in rows if 100 <= i <= 201 or i == 203)
    counted = sorted((str(r.doc_id), r.n_passage_words) for r in repeats.repeat_digests(df, passage_words=50).collect())
    assert counted == sorted((str(i), sum(g)) for (i, _), g in zip(rows, gone))


def test_long_documents_are_filed_in_stretches(shared, monkeypatch):
    """The same windows under the same files, whatever the stretches."""
    _, rows = shared

    def windows(raw, at=0):
        _, begin, count, files, *_ = repeats.find_runs(raw, np.array([0, len(raw)]), 400, 32)
        return [(at + b + k, f) for b, n, f in zip(begin.tolist(), count.tolist(), files.tolist()) for k in range(n)]

    monkeypatch.setattr(repeats, "SEGMENT", 150)
    for _, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        pieces = [w for _, at, part, _ in repeats._segments(raw, np.array([0, len(raw)]), 400) for w in windows(part, at)]
        assert pieces == windows(raw)


def test_awkward_rows_and_other_lengths(awkward, empty):
    df, rows = awkward
    assert sorted((str(r[0]), *r[1:]) for r in repeats.repeat_digests(df, 100).collect()) == brute(rows, 100)
    assert repeats.repeat_digests(empty).count() == 0


def test_texts_lose_their_repeats_and_keep_their_columns(shared):
    df, rows = shared
    left = repeats.without_repeats(df.withColumnRenamed("text", "text").selectExpr("text", "doc_id", "doc_id as did", "1 as spans"))
    assert left.columns == ["text", "doc_id", "did", "spans"] and left.count() == len(rows)
    size = {i: n - gone for i, n, gone, *_ in brute(rows, 400)}
    # A cut may take the other byte of an é with it, at either end of each run.
    assert all(0 <= size[str(r.doc_id)] - len(r.text.encode()) <= 6 for r in left.where("doc_id < 100").collect())
    assert [r.text for r in left.where("doc_id = 100").collect()] == [None]


def test_maximal_repeats_put_out_all_occurrences():
    parts = [b"xxabcdefgh1", b"yyabcdefgh2", b"zzabcdefgh3", b"qqabcdeXX"]
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    found = {(n, tuple(sorted(p.tolist()))) for n, p in repeats.maximal_repeats(data, offsets, 5)}
    starts = [offsets[i] + 2 for i in range(4)]
    assert found == {(8, tuple(starts[:3])), (5, tuple(starts))}
