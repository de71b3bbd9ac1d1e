"""Accounts of splits that hold a record in several versions, or whose source holds an id several times."""

import pandas as pd
import pytest
from compare import same
from pyspark.sql import functions as F

from corpusloom.operators import split
from corpusloom.plans.oracles import oracle_sql
from corpusloom.plans.queries import queries

FIELDS = "id string, title string, text string"


def documents(folder, copies: int) -> str:
    """7,000 short documents, 20 of which the planted faults put out both as they are and changed."""
    ids = list(range(7000)) * copies
    texts = [f"line {i}\nbody of {i}" for i in ids]
    frame = pd.DataFrame({"doc_id": ids, "text": texts, "lang": "en", "source": [f"src{i % 3}" for i in ids], "n_chars": list(map(len, texts))})
    frame.to_parquet(folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize(("other", "changed"), [("title!", 0), ("titl", 40)])
def test_the_least_version_is_compared(spark, other, changed):
    source = spark.createDataFrame([(f"r{i:02d}", "title", f"text {i}") for i in range(40)], FIELDS)
    splits = source.withColumn("split", F.lit("train")).unionByName(source.withColumns({"title": F.lit(other), "split": F.lit("test")}))
    assert split.split_accounting(source, splits).first().asDict() == {"missing": 0, "extra": 0, "changed": changed, "repeated": 0}


def test_records_of_one_id_are_all_accounted_for(spark):
    source = spark.createDataFrame([("a", "t", "x"), ("a", "t", "x"), ("a", "t", "y"), ("b", "t", "x"), ("b", "t", "x")], FIELDS)
    splits = spark.createDataFrame([("a", "t", "x", "train"), ("c", "t", "x", "test"), ("c", "t", "y", "test")], FIELDS + ", split string")
    assert split.split_accounting(source, splits).first().asDict() == {"missing": 2, "extra": 1, "changed": 1, "repeated": 1}


def test_nothing_to_account_for(spark):
    source = spark.createDataFrame([], FIELDS)
    assert split.split_accounting(source, source.withColumn("split", F.lit("train"))).first().asDict() == {"missing": 0, "extra": 0, "changed": 0, "repeated": 0}


@pytest.mark.parametrize("copies", [1, 2])
def test_accounts_match_sql_where_versions_meet(spark, tmp_path, copies):
    same(spark, documents(tmp_path, copies), queries()["split_accounting"], oracle_sql()["split_accounting"])


@pytest.mark.parametrize("copies", [1, 2])
def test_verdicts_match_sql_where_versions_meet(spark, tmp_path, copies):
    same(spark, documents(tmp_path, copies), queries()["split_verdict"], oracle_sql()["split_verdict"])
