"""Run a query and its SQL counterpart and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(cells, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(df, sql: str, con: duckdb.DuckDBPyConnection) -> str | None:
    """What differs between the frame and the statement, or None."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    wanted = _rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    spark_kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (k, kinds[c]) for c, k in df.dtypes if kinds[c] not in (spark_kinds.get(k), "NUMBER", "STRING", "BOOL")}
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(wanted):
        return f"{len(got)} rows and {len(wanted)}"
    for a, b in zip(got, wanted):
        if a != b:
            return f"{sorted(df.columns)}\n  spark {a}\n  sql   {b}"
    return f"types {odd}" if odd else None
