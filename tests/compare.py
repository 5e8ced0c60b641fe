"""Holds a query against its SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[:-8]
        c.execute(f"create view {name} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def _rows(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 9)) if isinstance(v, float) else repr(v)
    return sorted("|".join(show(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir: str, f, sql: str) -> list[str]:
    df = f(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connection(sf_dir).execute(sql)
    names = [x[0] for x in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {df.columns} and {names}"]
    if not want:
        return ["no rows"]
    return [] if got == want else [f"{len(got)} and {len(want)} rows", *[f"{a} / {b}" for a, b in zip(got, want) if a != b][:3]]
