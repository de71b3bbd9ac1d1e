"""Rows of a query against rows of its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def rows(frame) -> tuple[list[str], list[str]]:
    frame = frame[sorted(frame.columns)]
    plain = frame.astype(object).where(frame.notna(), None)
    return [f"{c}:{t}" for c, t in zip(frame.columns, map(str, frame.dtypes), strict=True)], sorted(map(repr, plain.itertuples(index=False, name=None)))


def same(spark, sf_dir: str, query, sql: str) -> None:
    ours, theirs = rows(query(spark, sf_dir).toPandas()), rows(connect(sf_dir).sql(sql).df())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
