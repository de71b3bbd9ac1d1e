"""Document quality by hierarchical empirical Bayes.

Evidence of a document: one logistic regression tells good form by shares of word
shapes and by how much the text repeats itself, another tells harmless content by
words that are met almost only in toxic documents. A document is good if both hold;
the log odds of that without the base rate are its log likelihood ratio. Sites lend
it a prior: the share of good documents of a host is
shrunk toward the global share, that of a path (here host and language) toward
its host, each by a Beta prior whose strength is fitted to how much sites differ.
A document's own evidence is left out of its site's share.

The regression is fitted on a bounded sample of labelled documents; everything
else covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import named
from corpusloom.llm import _bytes as B
from corpusloom.llm._shared import bounded_batches, materialize
from corpusloom.llm.shingles import word_spans

#: Labelled documents, by hash of their id, that the classifier is fitted on.
TRAIN_DOCUMENTS = 30_000
WORDS = 1 << 18
#: A word is a mark of toxic documents with so low log odds, in so many of them and in such a share.
MARK_ODDS, MARK_DOCUMENTS, MARK_SHARE = -2.5, 6, 0.03
#: A document stays when it is good with at least this probability.
LEAST_GOOD = 0.5

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLDED = np.where(_LETTERS, B.BYTE_HASH[np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))], np.uint64(0))


#: Last characters of words that have a share of their own; the others share one.
_TAILS = ".,!?;:*$%&#|~=+-_@\"')"
_TAIL = np.where(_LETTERS, 0, len(_TAILS) + 1)
_TAIL[[ord(c) for c in _TAILS]] = np.arange(1, len(_TAILS) + 1)
FORM = 2 * (len(_TAILS) + 2) + 7
DENSE = FORM + 3


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, end and hash of every word; the hash passes over case and signs."""
    start, end = word_spans(data, offsets)
    word = np.empty(len(start), np.int64)
    for some, first, last in B.stretches(start, end):
        prefix, a = B.prefix_hash(_FOLDED[data[first:last]]), start[some] - first
        word[some] = (B.mix64((prefix[end[some] - first] - prefix[a]) * B.powers(last - first + 1)[1][a]) & np.uint64(WORDS - 1)).astype(np.int64)
    return B.doc_of(offsets, start), start, end, word


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, word) of the distinct words of each document of a chunk."""
    doc, _, _, word = _words(data, offsets)
    cell = np.unique(doc * WORDS + word)
    return cell // WORDS, cell % WORDS


def features(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """DENSE numbers for each document of a chunk, FORM of them without ``marks``: which words speak against a document."""
    n = len(offsets) - 1
    doc, start, end, word = _words(data, offsets)
    total = np.bincount(doc, minlength=n)
    some = np.maximum(total, 1)

    def share(what: np.ndarray) -> np.ndarray:
        return np.bincount(doc, what, minlength=n) / some

    edges = np.stack((start, end), axis=1).ravel()
    kinds_of = ((data >= 97) & (data <= 122), (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), _LETTERS[data])
    lower, upper, digit, letter = (np.add.reduceat(np.append(m, False), edges, dtype=np.int32)[::2] if len(edges) else np.zeros(0, np.int32) for m in kinds_of)
    kinds = len(_TAILS) + 2
    last = _TAIL[data[end - 1]] if len(end) else np.zeros(0, np.int64)
    twice = (end - start > 1) & (data[end - 1] == data[np.maximum(end - 2, 0)]) if len(end) else np.zeros(0, bool)
    out = np.zeros((n, DENSE))
    out[:, :kinds] = np.bincount(doc * kinds + last, minlength=n * kinds).reshape(n, kinds) / some[:, None]
    out[:, kinds : 2 * kinds] = np.bincount(doc[twice] * kinds + last[twice], minlength=n * kinds).reshape(n, kinds) / some[:, None]
    cell = np.unique(doc * WORDS + word)
    distinct = np.bincount(cell // WORDS, minlength=n)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    hits = np.bincount((cell // WORDS)[marks[cell % WORDS]], minlength=n)
    rest = [share((upper > 1) & (lower == 0)), share(digit > 0), share(letter == 0), share(same), np.log1p(total), np.log1p(distinct) - np.log1p(total), share(np.minimum(end - start, 40)) / 10, np.minimum(hits, 1), np.minimum(hits, 4), hits / some * 50]
    out[:, 2 * kinds :] = np.stack(rest, axis=1)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Harmless (good) and toxic (bad) documents with each word; the row -1 counts documents. At most WORDS rows."""
    total = np.zeros((2, WORDS), np.int64)
    documents = np.zeros(2, np.int64)
    for batch in batches:
        good = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        documents += np.bincount(good, minlength=2)
        data, offsets = B.text_buffers(batch.column(0))
        for a, _, part, off in B.chunks(data, offsets):
            doc, word = distinct_words(part, off)
            np.add.at(total, (good[a + doc], word), 1)
    met = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), pa.array(np.append(total[1, met], documents[1])), pa.array(np.append(total[0, met], documents[0]))], names=["word", "good", "bad"])


def _one_label(labels: DataFrame) -> DataFrame:
    """doc_id, sound (quality is 1) and harmless (not toxic), 0 or 1, of every labelled document.

    Labels without an id or a quality are left out; of a doc_id with several labels
    the worst counts; an unknown toxicity is none.
    """
    sound, harmless = (F.col("quality") == 1).cast("int"), (F.coalesce("toxic", F.lit(0)) == 0).cast("int")
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(sound).alias("sound"), F.min(harmless).alias("harmless"))


def sample_labels(labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """At most ``most`` of the labelled documents: doc_id, sound, harmless."""
    return _one_label(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def good_share(docs: DataFrame, labels: DataFrame) -> float:
    """The share of good ones among all documents with a label; 1 without any. One row reaches the driver."""
    row = docs.select("doc_id").join(_one_label(labels), "doc_id").agg(F.avg(F.col("harmless") * F.col("sound")).alias("share")).first()
    return 1.0 if row.share is None else row.share


@dataclass
class Classifier:
    """Marks, the weights of both regressions, and the share of good documents they were fitted on."""

    marks: np.ndarray
    form: np.ndarray
    content: np.ndarray
    base: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad."""
        form, content = x[:, :FORM] @ self.form[1:] + self.form[0], x[:, FORM:] @ self.content[1:] + self.content[0]
        bad = np.logaddexp(0, -form) + np.logaddexp(0, -content)  # -log of both chances
        bad = np.clip(bad, 1e-9, 60)
        return -bad - np.log(-np.expm1(-bad)) - np.log(self.base / (1 - self.base))


def _regression(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Logistic regression with a weak ridge, by Newton steps; where only one class is there, it is certain."""
    if good.min() == good.max():
        return np.append(30.0 if good.min() else -30.0, np.zeros(x.shape[1]))
    design = np.column_stack((np.ones(len(x)), x))
    scale = np.maximum(design.std(axis=0), 1e-3)
    scale[0] = 1
    design /= scale
    beta = np.zeros(design.shape[1])
    ridge = np.full(design.shape[1], 0.5)
    ridge[0] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (good - p) - ridge * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 3 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return beta / scale


def fit(docs: DataFrame, sample: DataFrame) -> Classifier | None:
    """The classifier; None where the sample lacks good or bad documents.

    ``sample`` is bounded and is broadcast. Words are counted in the tasks first and
    of them only marks, which WORDS bounds, reach the driver; then come DENSE numbers
    for each sampled document.
    """
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "harmless", "sound")
    labelled = materialize(labelled, "labelled")
    kinds = labelled.agg(F.sum(F.col("harmless") * F.col("sound")).alias("good"), F.count("*").alias("n")).first()
    if not kinds.n or kinds.good in (0, kinds.n):
        return None
    counts = materialize(labelled.select("text", "harmless").mapInArrow(_counts, "word long, good long, bad long").groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "counts")
    totals = counts.where("word = -1").first()
    odds = F.log((F.col("good") + 0.5) / (totals.good + 1)) - F.log((F.col("bad") + 0.5) / (totals.bad + 1))
    marks = np.zeros(WORDS, bool)
    marks[[r.word for r in counts.where((F.col("word") >= 0) & (F.col("bad") >= max(MARK_DOCUMENTS, MARK_SHARE * totals.bad)) & (odds <= MARK_ODDS)).select("word").collect()]] = True
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_buffers(batch.column(0))
            for a, b, part, off in B.chunks(data, offsets):
                rows = features(part, off, shared.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([r.tobytes() for r in rows], pa.binary())], names=["harmless", "sound", "x"])

    table = labelled.mapInArrow(run, "harmless int, sound int, x binary").toArrow()
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(-1, DENSE).astype(np.float64)
    harmless, sound = (table.column(c).to_numpy().astype(np.float64) for c in ("harmless", "sound"))
    return Classifier(marks, _regression(x[:, :FORM], sound), _regression(x[:, FORM:], harmless), kinds.good / kinds.n)


def score_documents(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """doc_id, host, path, score: the evidence of each document, 0 without a classifier. Null source or lang count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_buffers(batch.column(3))
            score = np.zeros(batch.num_rows)
            for a, b, part, off in B.chunks(data, offsets):
                if shared.value is not None:
                    score[a:b] = shared.value.evidence(features(part, off, shared.value.marks))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.round(score, 6))], names=["doc_id", "host", "path", "score"])

    host, path = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, host string, path string, score double")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(shares: DataFrame, mean: Column) -> float:
    """Pseudo-documents of a Beta prior by the method of moments: what differs between sites beyond chance.

    One row reaches the driver.
    """
    n, share = F.col("n"), F.col("good") / F.col("n")
    r = shares.where("n >= 2").agg(F.sum(n * (share - mean) ** 2).alias("between"), F.sum(mean * (1 - mean)).alias("chance"), F.sum(n * mean * (1 - mean)).alias("spread"), F.sum(n).alias("n"), F.count("*").alias("k")).first()
    if not r.k:
        return 1e6
    # between ~ sum m(1-m) (1 + (n-1) rho), rho = 1 / (strength + 1)
    rho = (r.between - r.chance) / max(r.spread - r.chance, 1e-12)
    return float(1 / min(max(rho, 1e-6), 0.5) - 1)


def judge(scored: DataFrame, base: float) -> DataFrame:
    """doc_id, score, p_document, p_site, p_good, keep.

    p_document uses the global share as prior, p_site is the shrunk share of the
    document's path without itself, p_good combines both. Sites are aggregated
    before they are shuffled, so one that holds a third of all documents is a row for
    each task.
    """
    base = min(max(base, 1e-6), 1 - 1e-6)
    sure = scored.withColumn("llr", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("score"))))
    sure = sure.withColumn("p_document", 1 / (1 + F.exp(-(F.col("llr") + _logit(F.lit(base))))))
    paths = materialize(sure.groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum("p_document"), 6).alias("good")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    host_strength = _strength(hosts, F.lit(base))
    hosts = hosts.withColumn("host_share", (F.col("good") + host_strength * base) / (F.col("n") + host_strength))
    placed = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), "host_share"), "host")
    path_strength = _strength(placed, F.col("host_share"))
    mine = F.col("p_document")
    host_share = (F.col("host_good") - mine + host_strength * base) / (F.col("host_n") - 1 + host_strength)
    share = (F.col("good") - mine + path_strength * host_share) / (F.col("n") - 1 + path_strength)
    site = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), share))
    out = sure.join(placed, ["host", "path"]).withColumn("p_site", site)
    out = out.withColumn("p_good", 1 / (1 + F.exp(-(F.col("llr") + _logit(F.col("p_site"))))))
    rounded = [F.round(c, 6).alias(c) for c in ("score", "p_document", "p_site", "p_good")]
    return out.select("doc_id", *rounded, (F.col("p_good") >= LEAST_GOOD).alias("keep"))


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang, source): see ``judge``.

    Without labels of both kinds nothing tells good from bad, and every document
    stays. A null text has no
    words and so no evidence; null sources and languages are sites of their own;
    repeated rows count each; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    sample = materialize(sample_labels(labels), "sample")
    classifier = fit(docs, sample)
    scored = materialize(score_documents(docs, classifier), "scored")
    return judge(scored, good_share(docs, labels) if classifier else 1.0)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged; rows without a doc_id stay."""
    rejected = classify_quality(docs, labels).where("not keep").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*map(named, docs.columns))
