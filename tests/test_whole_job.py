"""Queries do their whole job: no prefix, stride or filter leaves rows out."""

import hashlib

import bench
from corpusloom.plans import queries as plans
from corpusloom.plans.views import view

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, texts) -> str:
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_windows_tile_the_whole_stream(spark, tmp_path):
    sf = tables(spark, tmp_path, [f"document {i}\n" + f"word{i} " * 200 for i in range(40)])
    streams = {}
    for r in sorted(plans._offsets(view(plans._docs(spark, sf), "v_records")).collect(), key=lambda r: r.tok_start):
        streams.setdefault(r.split, []).extend(r.tokens)
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    got = {(r.split, r.start): (r.x, r.y) for r in plans.queries()["next_token_windows"](spark, sf).collect()}
    assert got == {(k, s): (sha(v[s : s + 256]), sha(v[s + 1 : s + 257])) for k, v in streams.items() for s in range(0, len(v) - 256, 256)}


def test_headline_times_the_slow_queries_too():
    assert {"next_token_windows", "sample_windows", "encode", "token_offsets", "normalization_stats", "validation_summary", "duplicate_audit", "reason_counts", "split_accounting"} <= set(bench.HEADLINE)


def test_views_carry_whole_texts(spark, tmp_path):
    text = 'say "a\\b"\n' + "some words " * 600 + "copyright"
    sf = tables(spark, tmp_path, ["short text here", text])
    run = lambda name: plans.queries()[name](spark, sf).collect()
    assert {r.line_number: r.reasons for r in run("suspicious_records")}[2].split(",")[-4:] == ["body_longer_than_500", "body_longer_than_1000", "body_longer_than_5000", "contains_marker:copyright"]
    assert run("validation_summary")[0].longest == len(text)
    assert "body_longer_than_5000" in {r.id: r.reasons for r in run("content_reasons_classical")}["poem-0000002"]


def test_format_record_finds_the_form_of_poems_and_keeps_whole_texts(spark, tmp_path):
    texts = ["".join(chr(97 + (i + k * k) % 26) for k in range(64)) + " more text" * 300 for i in range(8)]
    sf = tables(spark, tmp_path, texts)
    rows = plans.queries()["format_record"](spark, sf).collect()
    whole = {r.id: r.formatted for r in rows if r.kind == "text"}
    poems = {r.id: r.formatted for r in rows if r.kind == "poem"}
    assert [whole[f"poem-{i + 1:07d}"].split("正文：", 1)[1] for i in range(8)] == texts
    found = {r.id: r.form for r in plans.queries()["label_form"](spark, sf).collect()}
    assert len(set(found.values()) - {None}) == 4
    assert {i: p.split("\n")[0] for i, p in poems.items()} == {i: f"体裁：{f}" if f else "朝代：唐朝" for i, f in found.items()}
