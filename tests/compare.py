"""A query beside its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def assert_same(df, sql: str, sf_dir: str) -> int:
    got = rows_of(df.columns, df.collect())
    found = duck(sf_dir).sql(sql)
    want = rows_of(found.columns, found.fetchall())
    assert sorted(df.columns) == sorted(found.columns)
    differing = [(g, w) for g, w in zip(got, want, strict=False) if g != w]
    assert len(got) == len(want), (len(got), len(want))
    assert not differing, differing[:3]
    return len(got)
