"""Run named queries on Spark and in DuckDB and compare schema and values."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

KINDS = {
    "tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "int", "hugeint": "int",
    "double": "float", "float": "float", "date": "date", "varchar": "text", "string": "text", "boolean": "bool",
}


def duckdb_views(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def compare(con, df, sql: str) -> dict:
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    rows = cursor.fetchall()
    types = {c[0]: c[1] for c in con.execute(f"DESCRIBE {sql}").fetchall()}
    order = sorted(names)
    columns_equal = order == sorted(df.columns)
    kinds_equal = columns_equal and all(
        KINDS.get(types[f.name].lower(), types[f.name]) == KINDS.get(f.dataType.simpleString(), "?")
        for f in df.schema
    )
    exact = columns_equal and {n: types[n].lower() for n in order} == {
        f.name: {"int": "integer", "string": "varchar"}.get(f.dataType.simpleString(), f.dataType.simpleString())
        for f in df.schema
    }
    found = df.select(*order).collect() if columns_equal else []
    left = Counter(tuple(_plain(v) for v in r) for r in found)
    at = [names.index(n) for n in order]
    right = Counter(tuple(_plain(r[i]) for i in at) for r in rows)
    return {
        "columns": columns_equal,
        "kinds": kinds_equal,
        "types": exact,
        "rows": (len(found), len(rows)),
        "values": columns_equal and left == right,
        "only_spark": list((left - right).items())[:3],
        "only_sql": list((right - left).items())[:3],
    }
