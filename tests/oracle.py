"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import pathlib

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = pathlib.Path(sf) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def _canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([[_plain(r[i]) for i in order] for r in rows])


def spark_rows(df):
    return _canonical(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    return _canonical([d[0] for d in cursor.description], cursor.fetchall())


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return None
    have, need = {tuple(r) for r in got[1]}, {tuple(r) for r in want[1]}
    extra, missing = list(have - need)[:3], list(need - have)[:3]
    return (
        f"{len(got[1])} rows vs {len(want[1])}; only spark {str(extra)[:600]}; "
        f"only sql {str(missing)[:600]}"
    )
