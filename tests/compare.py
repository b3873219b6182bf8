"""Run a registered query and its SQL side by side and compare names, types and values."""

from __future__ import annotations

import datetime as dt
import time

import duckdb
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
_TYPES = {
    T.StringType: "VARCHAR", T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE",
    T.BooleanType: "BOOLEAN", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP",
}


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _value(value):
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, query, sql, folder):
    """None if equal, else what differs; plus the row count and the Spark seconds."""
    started = time.perf_counter()
    frame = query(spark, folder)
    got = [tuple(r) for r in frame.collect()]
    seconds = time.perf_counter() - started
    connection = connect(folder)
    types = {r[0]: r[1] for r in connection.execute(f"DESCRIBE {sql}").fetchall()}
    want = connection.execute(sql).fetchall()
    mine = {f.name: _TYPES.get(type(f.dataType), f.dataType.simpleString()) for f in frame.schema.fields}
    problem = None
    if mine != types:
        problem = f"schema {mine} <> {types}"
    elif len(got) != len(want):
        problem = f"rows {len(got)} <> {len(want)}"
    else:
        a, b = _rows(list(frame.columns), got), _rows(list(types), want)
        different = [(x, y) for x, y in zip(a, b) if x != y]
        if different:
            problem = f"{len(different)} rows differ, first {str(different[0])[:1500]}"
    return problem, len(got), seconds
