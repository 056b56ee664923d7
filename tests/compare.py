"""Compare a Spark frame with a DuckDB query on the same files, independent of row and column order."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value: object) -> object:
    if value is None:
        return None
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(r[i]) for i in order) for r in map(tuple, rows)), key=repr
    )


SPARK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences as text; empty when both sides agree in names, types and values."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    types = {d[0]: str(d[1]) for d in relation.description}
    expected = rows_of(names, relation.fetchall())
    actual = rows_of(df.columns, df.collect())
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns: spark {sorted(df.columns)} sql {sorted(names)}"]
    for name, kind in df.dtypes:
        if SPARK_TYPES.get(kind) != types[name]:
            problems.append(f"type of {name}: spark {kind} sql {types[name]}")
    if len(expected) != len(actual):
        problems.append(f"rows: spark {len(actual)} sql {len(expected)}")
    bad = [(a, e) for a, e in zip(actual, expected) if a != e]
    if bad:
        problems.append(f"{len(bad)} rows differ; columns {sorted(names)}\n  spark {bad[0][0]}\n  sql   {bad[0][1]}")
    return problems
