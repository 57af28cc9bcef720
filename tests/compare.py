"""Runs a query and its SQL side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{Path(sf_dir, n)}.parquet'")
    return con


def plain(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def difference(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """What is wrong, or nothing."""
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)}, and {sorted(names)}"
    at = [names.index(c) for c in df.columns]
    other = [tuple(r[i] for i in at) for r in want.fetchall()]
    a, b = sorted(tuple(map(plain, r)) for r in rows), sorted(tuple(map(plain, r)) for r in other)
    if a != b:
        only = lambda p, q: [x for x in p if x not in set(q)][:2]
        return f"{len(a)} rows, and {len(b)}: {str(only(a, b))[:700]} -- {str(only(b, a))[:700]}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(names, (str(x[1]) for x in want.description), strict=True))
    odd = {c: (t, types[c]) for c, t in df.dtypes if kinds.get(t) and kinds[t] != types[c] and not (kinds[t] == "VARCHAR" and types[c] == "STRING")}
    return f"types {odd}" if odd else ""
