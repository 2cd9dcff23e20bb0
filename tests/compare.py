"""Compare a registered query with its SQL twin, by value and regardless of order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from reviewlake.plans.fixtures import TABLES
from reviewlake.plans.registry import Query

SPARK_KIND = {"string": "text", "bigint": "int", "int": "int", "double": "float", "boolean": "bool",
              "timestamp_ntz": "time", "timestamp": "time", "date": "date"}
DUCK_KIND = {"VARCHAR": "text", "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "BOOLEAN": "bool",
             "TIMESTAMP": "time", "DATE": "date"}


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def canonical(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def bag(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(spark, sf_dir: str, query: Query) -> tuple[bool, str]:
    frame = query.run(spark, sf_dir)
    rows = frame.collect()
    if query.sql is None:
        return True, f"{len(rows)} rows, no oracle"
    relation = oracle_connection(sf_dir).sql(query.sql)
    ours = {name: SPARK_KIND.get(kind, kind) for name, kind in frame.dtypes}
    theirs = {name: DUCK_KIND.get(str(kind), str(kind)) for name, kind in zip(relation.columns, relation.types)}
    if ours != theirs:
        return False, f"schema {sorted(set(ours.items()) ^ set(theirs.items()))}"
    got, want = bag(frame.columns, rows), bag(relation.columns, relation.fetchall())
    if got != want:
        return False, (f"{sum(got.values())} vs {sum(want.values())} rows; only ours {list((got - want).items())[:2]}; "
                       f"only oracle {list((want - got).items())[:2]}")
    return True, f"{len(rows)} rows"
