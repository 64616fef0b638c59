"""Run a registered query on both engines and report the first difference."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int,)):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if hasattr(value, "tolist"):
        return _cell(value.tolist())
    return value


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


KINDS = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "BIGINT": "int",
    "INTEGER": "int", "HUGEINT": "huge", "double": "float", "float": "float", "DOUBLE": "float",
    "FLOAT": "float", "string": "str", "VARCHAR": "str", "boolean": "bool", "BOOLEAN": "bool",
    "date": "date", "DATE": "date", "timestamp": "ts", "timestamp_ntz": "ts", "TIMESTAMP": "ts",
    "TIMESTAMP_NS": "ts",
}


def compare(df, sql: str, con) -> str | None:
    """Return None when equal, else a short description."""
    names = sorted(df.columns)
    types = dict(df.dtypes)
    result = con.execute(sql)
    described = result.description
    columns = [d[0] for d in described]
    other = sorted(columns)
    if names != other:
        return f"columns {names} vs {other}"
    kinds = {d[0]: str(d[1]) for d in described}
    for name in names:
        a, b = KINDS.get(types[name], types[name]), KINDS.get(kinds[name], kinds[name])
        if a != b:
            return f"type of {name}: {types[name]} vs {kinds[name]}"
    spark_rows = [tuple(_cell(r[n]) for n in names) for r in df.collect()]
    order = [columns.index(n) for n in names]
    duck_rows = [tuple(_cell(r[i]) for i in order) for r in result.fetchall()]
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}"
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    for a, b in zip(sorted(spark_rows, key=key), sorted(duck_rows, key=key), strict=True):
        if a != b:
            return f"{names}: {a} vs {b}"
    return None
