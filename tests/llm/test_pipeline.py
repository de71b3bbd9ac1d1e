"""Each stage against a plain version of it on its own input."""

import random

import corpus_pipeline
from compare import SF
from conftest_llm import words
from pyspark.sql import functions as F
from test_neardup import brute
from test_repeats import brute_words

from corpusloom.llm._shared import materialize


def test_stages_on_the_smallest_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeats", "secrets", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, before, SF), name)
        assert docs.columns == before.columns
        kept[name] = (before, docs)
    before, after = kept["quality"]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stays = {r.doc_id for r in after.collect()}
    clean = [i for i, (q, t) in labels.items() if q == 1 and t == 0]
    assert sum(i in stays for i in clean) >= 0.9 * len(clean)
    before, after = kept["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {int(i) for i, _, c in brute(rows) if i == c}
    before, after = kept["repeats"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    left = {r.doc_id: r for r in after.collect()}
    assert len(left) == len(rows)
    split, gone = brute_words(rows, 50)
    assert any(map(any, gone))
    for (i, text), words, out in zip(rows, split, gone):
        assert left[i].text.split() == [w for w, g in zip(words, out) if not g] and left[i].n_chars == len(left[i].text)
        assert any(out) or left[i].text == text
    before, after = kept["secrets"]
    assert after.count() == before.count() and after.where(F.col("text").rlike("AKIA[A-Z0-9]{12,}")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


LABELS = [(1, 1, 0), (2, 0, 0), (None, 1, 1), (3, None, None)]


def documents(spark, folder, rows, labels=LABELS):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_on_empty_tables_and_awkward_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, documents(spark, tmp_path / "none", [])).count() == 0
    rng = random.Random(1)
    text = words(rng, 90)
    rows = [(1, text, "en", "a", None), (2, text, None, None, 3), (None, text, "en", "a", 1), (None, None, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (4, "", "en", "a", 0), (5, "one two", "en", "b", 7), (6, words(rng, 30_000), "en", "b", 7)]
    packed = corpus_pipeline.run(spark, documents(spark, tmp_path / "some", rows)).collect()
    assert {5, 6, 3, 4} <= {r.doc_id for r in packed} and all(r.length <= 2048 for r in packed)


def test_stages_pass_further_columns_of_any_name(spark, tmp_path):
    rng = random.Random(2)
    folder = documents(spark, tmp_path, [(i, words(rng, 70), "en", f"s{i % 3}", 1) for i in range(12)], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clashing = ("spans", "base", "row", "rest", "did", "th", "key", "id", "u", "v", "component", "component_id", "kept", "score", "host", "path", "keep", "__node", "tested", "packed")
    for i, name in enumerate(clashing):
        docs = docs.withColumn(name, F.lit(i))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, folder), name)
        assert out.columns == docs.columns and out.count() == 12, name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() == 12


def test_names_with_dots_and_backticks_pass_every_stage(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(40, 90)) + (" token=abcdefgh1" if i % 5 == 0 else ""), "en", "s", 1) for i in range(30)] + [(90, words(random.Random(6), 60), None, None, None)]
    folder = documents(spark, tmp_path / "odd", rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"a.b": F.lit(1), "a`b": F.lit("x"), "row": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, folder), name)
        assert out.columns == docs.columns and out.count() <= docs.count()
        docs = out
    assert docs.count() > 20 and {tuple(r) for r in docs.select("`a.b`", "`a``b`", "row").distinct().collect()} == {(1, "x", 2)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 20
