"""Run registered queries on Spark and their reference SQL on DuckDB, and compare."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Spark type name to the DuckDB type that must come out of the reference SQL.
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _bag(rows) -> Counter:
    return Counter(tuple(_plain(v) for v in row) for row in rows)


def difference(df, db, sql: str) -> str | None:
    """None if both sides hold the same rows and types, else what differs."""
    columns = sorted(df.columns)
    frame = df.select(*columns)
    described = {r[0]: r[1] for r in db.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(described) != columns:
        return f"columns {columns} against {sorted(described)}"
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    for name in columns:
        wanted = KINDS.get(kinds[name], kinds[name].upper())
        if wanted != described[name]:
            return f"type of {name}: {kinds[name]} against {described[name]}"
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = _bag(db.execute(f"SELECT {quoted} FROM ({sql}) AS t").fetchall())
    found = _bag(frame.collect())
    if expected == found:
        return None
    return (
        f"rows {sum(found.values())} against {sum(expected.values())}; "
        f"only Spark: {list((found - expected).items())[:3]}; only SQL: {list((expected - found).items())[:3]}"
    )
