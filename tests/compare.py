"""Rows of a Spark query against those of its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    expected = rows_of(found.fetchall(), [d[0] for d in found.description])
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    assert got[0] == expected[0]
    assert got[1] == expected[1]
