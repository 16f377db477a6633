"""Compare a Spark result with DuckDB SQL on the same parquet files, ignoring row order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v + 0.0, 9) + 0.0
    if hasattr(v, "tolist"):
        return v.tolist()
    return v


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(_norm(v) for v in r) for r in zip(*cols)), key=repr)


KIND = {
    "int64": "BIGINT",
    "int32": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "large_string": "VARCHAR",
    "bool": "BOOLEAN",
}


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    left = spark_df.toArrow()
    right = con.execute(sql).to_arrow_table()
    if sorted(left.column_names) != sorted(right.column_names):
        return f"columns {sorted(left.column_names)} != {sorted(right.column_names)}"
    for n in left.column_names:
        lt = KIND.get(str(left.schema.field(n).type), str(left.schema.field(n).type))
        rt = KIND.get(str(right.schema.field(n).type), str(right.schema.field(n).type))
        if lt != rt:
            return f"type of {n}: {lt} != {rt}"
    a, b = rows_of(left), rows_of(right)
    if len(a) != len(b):
        return f"row count {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0][0]} != {bad[0][1]} cols {sorted(left.column_names)}"
    return None
