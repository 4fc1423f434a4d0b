"""Compare registered queries with their DuckDB twins."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (value + 0.0)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day).isoformat()
    return str(value)


def compare(df, con, sql: str) -> str:
    """'' when rows, columns and values agree, else what differs."""
    mine = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order_a = [df.columns.index(c) for c in sorted(df.columns)]
    order_b = [names.index(c) for c in sorted(names)]
    a = Counter(tuple(plain(r[i]) for i in order_a) for r in mine)
    b = Counter(tuple(plain(r[i]) for i in order_b) for r in theirs)
    if a != b:
        return (f"rows {sum(a.values())} vs {sum(b.values())}; only spark {list((a - b).items())[:3]}; "
                f"only duckdb {list((b - a).items())[:3]}")
    return ""
