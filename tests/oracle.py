"""Compare a registered query with its SQL form in DuckDB on the same files."""

from __future__ import annotations

import datetime
import glob
import math
import os
from collections import Counter

import duckdb

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "float": "FLOAT",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(folder: str = SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def compare(spark, con, run, sql, folder: str = SF_DIR) -> list[str]:
    """Differences found (empty when equal)."""
    df = run(spark, folder)
    spark_types = dict(df.dtypes)
    rows = [r.asDict(recursive=True) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    duck_types = {d[0]: str(d[1]) for d in cursor.description}
    duck_rows = cursor.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns differ: spark {sorted(df.columns)} sql {sorted(names)}"]
    for c in names:
        want = spark_types[c]
        base = want.replace("array<", "").replace(">", "")
        suffix = "[]" if want.startswith("array<") else ""
        if base in TYPES and TYPES[base] + suffix != duck_types[c]:
            problems.append(f"type of {c}: spark {want} sql {duck_types[c]}")
    order = sorted(names)
    left = Counter(tuple(plain(r[c]) for c in order) for r in rows)
    right = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in duck_rows)
    if left != right:
        only_left, only_right = left - right, right - left
        problems.append(
            f"rows: spark {len(rows)} sql {len(duck_rows)}; {order}\n  only spark {sum(only_left.values())}: "
            f"{sorted(only_left, key=str)[:3]}\n  only sql {sum(only_right.values())}: {sorted(only_right, key=str)[:3]}"
        )
    if not rows:
        problems.append("no rows")
    return problems
