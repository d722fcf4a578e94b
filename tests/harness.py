"""Compares a query with its SQL text over the same parquet files."""

from __future__ import annotations

import math
import time

import duckdb

from rasterlake.plans.fixtures import BASE


TIMES = [0.0, 0.0]  # seconds of the last comparison: Spark, SQL engine


def sql_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, sf_dir: str, sql: str) -> str | None:
    started = time.time()
    got_names, got = canonical(df.columns, df.collect())
    between = time.time()
    want_names, want = canonical(*sql_rows(sf_dir, sql))
    TIMES[:] = [between - started, time.time() - between]
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        extra = sorted(set(got) - set(want))[:3]
        missing = sorted(set(want) - set(got))[:3]
        return f"rows {len(got)} != {len(want)}; extra {extra}; missing {missing}; columns {got_names}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}; columns {got_names}"
    return None
