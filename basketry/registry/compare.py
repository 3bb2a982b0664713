"""Run one registered query on Spark and its SQL on DuckDB and compare the rows."""
from __future__ import annotations

import datetime as dt
import decimal
import glob
import os


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = [tuple(_plain(r[i]) for i in order) for r in rows]
    return names, sorted(data, key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    rel = con.execute(sql)
    want_names, want = _rows([d[0] for d in rel.description], rel.fetchall())
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    types = [type(v) for row in got[:50] for v in row]
    expected = [type(v) for row in want[:50] for v in row]
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} rows differ, first {bad[0]}"
    if types != expected:
        return f"value types differ {set(types)} {set(expected)}"
    return None
