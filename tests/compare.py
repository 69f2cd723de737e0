"""Compare a Spark result with a DuckDB statement over the same parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        raise TypeError("a decimal column reached the result")
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [repr([plain(r[i]) for i in order]) for r in rows]
    out.sort()
    return [columns[i] for i in order], out


def differences(frame, con, sql, limit=3):
    """An empty text when both results hold the same rows, else what differs."""
    spark_cols, spark_rows = canonical(frame.columns, frame.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    sql_cols, sql_rows = canonical(names, cursor.fetchall())
    if spark_cols != sql_cols:
        return f"columns differ: only spark {sorted(set(spark_cols) - set(sql_cols))}, " \
               f"only sql {sorted(set(sql_cols) - set(spark_cols))}"
    if not spark_rows:
        return "no rows"
    if spark_rows == sql_rows:
        return ""
    a, b = set(spark_rows), set(sql_rows)
    text = f"{len(spark_rows)} spark rows, {len(sql_rows)} sql rows, {len(a - b)} differ\n  {spark_cols}\n"
    for s, d in zip(sorted(a - b)[:limit], sorted(b - a)[:limit]):
        text += f"  spark {s}\n  sql   {d}\n"
    return text
