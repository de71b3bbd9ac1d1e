"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]

from conftest_llm import words  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows() -> list[tuple]:
    rng = random.Random(7)
    base = words(rng, 120)
    rows = [(i, words(rng, rng.randint(6, 90))) for i in range(30)]
    parts = base.split(" ")
    for i in range(30, 60):  # near copies of one original, some too far from it
        changed = list(parts)
        for _ in range(rng.randint(0, 6)):
            changed[rng.randrange(len(changed))] = "zz"
        rows.append((i, " ".join(changed)))
    rows += [(60 + i, base) for i in range(5)]
    rows += [(70, None), (71, ""), (72, " \n\t"), (73, "one two"), (74, "ONE Two"), (75, "one two three four five"), (76, "a" * 5000), (77, words(rng, 4000)), (78, "ab " * 900)]
    rows += [(79, "x y z x y z x y z x y z"), (79, "x y z x y z x y z x y z"), (79, words(rng, 8)), (None, base), (None, None), (80, "\x00\x00tail\x00"), (81, "日本語 テスト 😀 a　b"), (82, "<|endoftext|> don't we'll  'tis")]
    return [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s1", None]), None) for i, t in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    """(DataFrame, rows): documents with columns whose names clash with inner ones."""
    rows = awkward_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    return df, [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)

