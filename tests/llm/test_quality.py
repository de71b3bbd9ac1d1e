import math
import random
import re

import numpy as np
from compare import SF
from pyspark.sql import functions as F

from corpusloom.llm import quality
from corpusloom.llm.queries import queries

LABELS = "doc_id long, quality int, toxic int"


def corpus(rng):
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "over", "stones", "and", "sings,", "softly."]) for _ in range(80))
    rows, labels = [], []
    for i in range(900):
        kind = i % 5
        text = good()
        if kind == 0:
            text = text.upper().replace(" ", "!! ")
        elif kind == 1:
            words = text.split()
            words[rng.randrange(80)] = "vile"
            text = " ".join(words)
        rows.append((i, text, rng.choice(["en", "fr"]), "hot" if i % 3 else f"s{i % 7}", None))
        if i % 2:
            labels.append((i, 0 if kind == 0 else 1, int(kind == 1)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(random.Random(1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").repartition(4)
    got = {r.doc_id: r for r in quality.classify_quality(docs, spark.createDataFrame(labels, LABELS)).collect()}
    unseen = [i for i in range(0, 900, 2)]
    assert sum(got[i].keep for i in unseen if i % 5 > 1) >= 0.97 * sum(i % 5 > 1 for i in unseen)
    assert sum(not got[i].keep for i in unseen if i % 5 <= 1) >= 0.95 * sum(i % 5 <= 1 for i in unseen)
    assert all(0 <= r.p_site <= 1 and 0 <= r.p_good <= 1 for r in got.values())


def test_sparse_sites_shrink_to_their_host_and_it_to_all(spark):
    scored = [(i, "big", "en", 4.0) for i in range(300)] + [(i, "bad", "en", -4.0) for i in range(300, 600)] + [(600, "bad", "fr", 0.0), (601, "new", "en", 0.0)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(scored, "doc_id long, host string, path string, score double"), 0.5).collect()}
    assert out[0].p_site > 0.9 and out[300].p_site < 0.1 and out[600].p_site < 0.3 and abs(out[601].p_site - 0.5) < 0.05


def test_awkward_rows(spark, awkward, empty):
    df, rows = awkward
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (70, 0, 0), (71, 1, 0), (None, 1, 1), (3, None, 0), (1, 0, 0)], LABELS)
    assert quality.classify_quality(df, labels).count() == len(rows)
    nothing = quality.classify_quality(df, labels.where("false"))
    assert nothing.count() == len(rows) and all(r.keep for r in nothing.collect())
    assert quality.keep_good(df, labels.where("false")).columns == df.columns
    assert quality.classify_quality(empty, labels).count() == 0


def test_prior_counts_all_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} some more words {i}", "en", "s") for i in range(200)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 10 > 2), 0) for i in range(260)], "doc_id long, quality int, toxic int")
    whole, bases = quality.sample_labels, []
    monkeypatch.setattr(quality, "sample_labels", lambda labels: whole(labels, 17))
    monkeypatch.setattr(quality, "judge", lambda scored, base: bases.append(base))
    quality.classify_quality(docs, labels)
    assert abs(bases[0] - 0.7) < 1e-12


def plain_features(text, marks):
    """The numbers of one document, word by word."""
    raw = (text or "").encode()
    kinds, letters = len(quality._TAILS) + 2, set(quality._LETTERS.nonzero()[0].tolist())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    some = max(len(words), 1)
    tails = [0.0] * (2 * kinds)
    names, shape = [], [0.0] * 5
    for w in words:
        last = 0 if w[-1] in letters else 1 + quality._TAILS.index(chr(w[-1])) if chr(w[-1]) in quality._TAILS else kinds - 1
        tails[last] += 1 / some
        tails[kinds + last] += (len(w) > 1 and w[-1] == w[-2]) / some
        lower, upper = sum(97 <= c <= 122 for c in w), sum(65 <= c <= 90 for c in w)
        for i, x in enumerate((upper > 1 and lower == 0, any(48 <= c <= 57 for c in w), not any(c in letters for c in w))):
            shape[i] += x / some
        shape[4] += min(len(w), 40) / 10 / some
        # A word's hash passes over signs, so it is that of its letters in their places.
        data = np.frombuffer(w, np.uint8)
        names.append(int(quality._words(data, np.array([0, len(w)]))[3][0]))
    shape[3] = sum(a == b for a, b in zip(names, names[1:])) / some
    hits = sum(bool(marks[n]) for n in set(names))
    size = math.log1p(len(words))
    return [*tails, *shape[:3], shape[3], size, math.log1p(len(set(names))) - size, shape[4], min(hits, 1), min(hits, 4), hits / some * 50]


def plain_judgement(rows, classifier, base):
    """score, p_document, p_site, p_good of each (doc_id, text, lang, source) by plain loops over all documents of its site."""
    logit, expit = lambda p: math.log(p / (1 - p)), lambda x: 1 / (1 + math.exp(-x))
    scores, site, mine = {}, {}, {}
    for i, text, lang, source in rows:
        x = plain_features(text, classifier.marks)
        form = classifier.form[0] + sum(a * b for a, b in zip(x[: quality.FORM], classifier.form[1:]))
        content = classifier.content[0] + sum(a * b for a, b in zip(x[quality.FORM :], classifier.content[1:]))
        good = expit(form) * expit(content)
        good = min(max(good, math.exp(-60)), math.exp(-1e-9))
        scores[i] = round(logit(good) - logit(classifier.base), 6)
        mine[i] = expit(min(max(scores[i], -30), 30) + logit(base))
        site[i] = (source or "", lang or "")
    paths, hosts = {}, {}
    for i, s in site.items():
        paths.setdefault(s, []).append(mine[i])
        hosts.setdefault(s[0], []).append(mine[i])

    def strength(groups, mean):
        several = [(len(g), sum(g) / len(g), mean(k)) for k, g in groups.items() if len(g) >= 2]
        between = sum(n * (share - m) ** 2 for n, share, m in several)
        chance, spread = sum(m * (1 - m) for _, _, m in several), sum(n * m * (1 - m) for n, _, m in several)
        return 1 / min(max((between - chance) / (spread - chance), 1e-6), 0.5) - 1

    a = strength(hosts, lambda _: base)
    b = strength(paths, lambda s: (sum(hosts[s[0]]) + a * base) / (len(hosts[s[0]]) + a))
    out = {}
    for i, s in site.items():
        host = (sum(hosts[s[0]]) - mine[i] + a * base) / (len(hosts[s[0]]) - 1 + a)
        share = min(max((sum(paths[s]) - mine[i] + b * host) / (len(paths[s]) - 1 + b), 1e-6), 1 - 1e-6)
        out[i] = (scores[i], mine[i], share, expit(min(max(scores[i], -30), 30) + logit(share)))
    return out


def test_query_equals_a_plain_version(spark, tmp_path, monkeypatch):
    """op2 on whole tables against loops: features, both regressions' scores, priors and posteriors, given the weights."""
    rows, labels = corpus(random.Random(4))
    rows = [(i, None if i == 7 else "" if i == 8 else t if i % 11 else f"{t} 2024 WORLD -- it's,, ok!! é", lang if i % 13 else None, source if i % 17 else None) for i, t, lang, source, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    made, whole = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: made.append(whole(*a)) or made[-1])
    got = {r.doc_id: r for r in queries()["op2_quality_classifier"](spark, str(tmp_path)).collect()}
    base = sum(q == 1 and not t for _, q, t in labels) / len(labels)
    want = plain_judgement(rows, made[0], base)
    assert got.keys() == want.keys()
    for i, values in want.items():
        r = got[i]
        assert all(abs(a - b) <= 2e-6 * max(1, abs(b)) for a, b in zip((r.score, r.p_document, r.p_site, r.p_good), values)), (i, r, values)
        assert r.keep == (values[3] >= 0.5) or abs(values[3] - 0.5) < 1e-6


def test_held_out_calibration(spark):
    """What documents without labels in training turn out to be, by their p_good, on the given test table."""
    docs, labels = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    got = {r.doc_id: r for r in quality.classify_quality(docs.join(labels, "doc_id", "left_semi"), labels.where(fold == 0)).collect()}
    truth = {r.doc_id: r.quality == 1 and not r.toxic for r in labels.where(fold == 1).collect()}
    pairs = [(got[i].p_good, good) for i, good in truth.items() if i in got]
    assert len(pairs) > 500
    kept, dropped = [g for p, g in pairs if p >= 0.5], [g for p, g in pairs if p < 0.5]
    good = sum(g for _, g in pairs)
    print(f"held out: {len(pairs)}, good kept {sum(kept) / good:.3f}, bad dropped {dropped.count(False) / (len(pairs) - good):.3f}, Brier {sum((p - g) ** 2 for p, g in pairs) / len(pairs):.4f}")
    assert sum(kept) >= 0.97 * good and dropped.count(False) >= 0.8 * (len(pairs) - good)
    assert sum((p - g) ** 2 for p, g in pairs) / len(pairs) < 0.06
