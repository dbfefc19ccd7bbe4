"""Run registered queries against their SQL in DuckDB and compare values."""

from __future__ import annotations

import datetime
import decimal
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.6g}" if abs(value) > 1e-9 else "0"
    if isinstance(value, int):
        return f"{float(value):.6g}" if abs(value) < 10**6 else str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(_plain(v)) for v in value) + "]"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(x) for x in r)
    )


def compare(spark, sf_dir, fn, sql, con=None):
    con = con or database(sf_dir)
    started = time.time()
    df = fn(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_seconds = time.time() - started
    if sql is None:
        return None, f"{len(ours[1])} rows (no SQL)", spark_seconds, 0.0
    started = time.time()
    cursor = con.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    sql_seconds = time.time() - started
    if ours[0] != theirs[0]:
        return False, f"columns {ours[0]} != {theirs[0]}", spark_seconds, sql_seconds
    if len(ours[1]) != len(theirs[1]):
        return False, f"{len(ours[1])} rows != {len(theirs[1])}; ours {ours[1][:2]} theirs {theirs[1][:2]}", spark_seconds, sql_seconds
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            return False, f"first difference {dict(zip(ours[0], a))} != {dict(zip(ours[0], b))}", spark_seconds, sql_seconds
    return True, f"{len(ours[1])} rows", spark_seconds, sql_seconds
