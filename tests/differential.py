"""Spark rows against DuckDB's for the same tables."""

from __future__ import annotations

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(v):
        """A text that tells null from empty and keeps nine digits of fractions: sums come in any order."""
        if v is None:
            return "\0null"
        if isinstance(v, (float, decimal.Decimal)):
            return "nan" if v != v else f"{float(v):.9g}"
        return f"{v:.9g}" if isinstance(v, int) and abs(v) < 10**9 and not isinstance(v, bool) else str(v)

    return sorted(tuple(value(r[k]) for k in order) for r in rows)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    got_rows, want_rows = canonical(df.columns, [tuple(r) for r in df.collect()]), canonical(want.columns, want.fetchall())
    assert len(got_rows) == len(want_rows)
    assert got_rows == want_rows
