"""Comparison of a Spark result with DuckDB's over the same tables."""

from __future__ import annotations

import decimal
import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, Row

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, (Row, tuple, list)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return bytes(v) if isinstance(v, bytearray) else v


def rows(names: list[str], values) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


def assert_same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """That both give the same columns, kinds and rows; the number of rows."""
    got = con.execute(sql)
    names, kinds = [d[0] for d in got.description], {d[0]: str(d[1]) for d in got.description}
    assert sorted(names) == sorted(df.columns)
    want, have = rows(names, got.fetchall()), rows(df.columns, df.collect())
    assert have == want, f"only in Spark: {list((have - want).items())[:3]}; only in SQL: {list((want - have).items())[:3]}"
    off = {c: (k, kinds[c]) for c, k in df.dtypes if k in _KINDS and kinds[c] != _KINDS[k]}
    assert not off, off
    return have.total()
