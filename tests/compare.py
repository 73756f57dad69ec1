"""Runs queries in Spark and their SQL in DuckDB and compares every value."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


_KINDS = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float",
    "string": "text", "boolean": "bool", "timestamp_ntz": "time", "timestamp": "time", "date": "date",
    "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "text", "BOOLEAN": "bool",
    "TIMESTAMP": "time", "DATE": "date",
}


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def problems(df, con, sql):
    """Differences between a Spark result and a DuckDB result, as texts."""
    relation = con.sql(sql)
    theirs_names = list(relation.columns)
    if sorted(df.columns) != sorted(theirs_names):
        return [f"columns {sorted(df.columns)} against {sorted(theirs_names)}"]
    kinds = dict(zip(theirs_names, (str(t) for t in relation.types)))
    found = [
        f"type of {n}: {t} against {kinds[n]}" for n, t in df.dtypes
        if _KINDS.get(t) != _KINDS.get(kinds[n], "?")
    ]
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = _rows(theirs_names, relation.fetchall())
    if len(mine) != len(theirs):
        found.append(f"{len(mine)} rows against {len(theirs)}")
    if mine != theirs:
        differing = [(a, b) for a, b in zip(mine, theirs) if a != b][:3]
        found.append(f"values differ: {differing}")
    if not mine:
        found.append("no rows at all")
    return found
