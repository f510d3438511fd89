"""Runs a registered query and its SQL side by side and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(os.path.join(sf, "*.parquet"))):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=repr)


def differences(spark, sf, query, sql, con=None) -> list[str]:
    """What differs between the query's rows and the SQL's, as messages."""
    df = query(spark, sf)
    ours = _rows(df.columns, df.collect())
    done = (con or connect(sf)).execute(sql)
    names = [d[0] for d in done.description]
    theirs = _rows(names, done.fetchall())
    out = []
    if sorted(df.columns) != sorted(names):
        out.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} != {len(theirs)}")
    if not out and ours != theirs:
        only_ours = sorted((Counter(ours) - Counter(theirs)).elements(), key=repr)
        only_theirs = sorted((Counter(theirs) - Counter(ours)).elements(), key=repr)
        out.append(f"{len(only_ours)} rows differ")
        out += [f"{a} != {b}" for a, b in zip(only_ours[:3], only_theirs[:3])]
    return out
