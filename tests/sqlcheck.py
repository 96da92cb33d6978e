"""Compare registered queries with their SQL on DuckDB.

Usage: python tests/sqlcheck.py FOLDER [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NA or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item() if getattr(value, "ndim", 0) == 0 else list(value)
    if isinstance(value, float):
        return int(value) if math.isfinite(value) and value == int(value) and abs(value) < 1e15 else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value if isinstance(value, (int, str, bool)) else str(value)


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted((tuple(_cell(v) for v in row) for row in pdf[columns].itertuples(index=False)), key=repr)


def kind(column):
    """Type of a column's values: int, float, bool, str, time or what objects it holds."""
    letter = column.dtype.kind
    if letter == "O":
        present = [v for v in column if v is not None]
        return type(present[0]).__name__ if present else "str"
    return {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "time", "T": "str", "U": "str"}.get(letter, letter)


def compare(spark_df, con, sql):
    """'' when both sides agree, else the first difference."""
    ours, theirs = spark_df.toPandas(), con.execute(sql).df()
    left_columns, left = rows(ours)
    right_columns, right = rows(theirs)
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}", len(left)
    if len(left) == len(right) and left:
        kinds = {c: (kind(ours[c]), kind(theirs[c])) for c in left_columns}
        # pandas turns whole numbers with nulls into floats on one side only.
        wrong = {c: k for c, k in kinds.items() if k[0] != k[1] and not (set(k) == {"int", "float"} and theirs[c].isna().any())}
        if wrong:
            return f"types {wrong}", len(left)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}; first {left[:2]} / {right[:2]}", len(left)
    for a, b in zip(left, right):
        if a != b:
            return f"{a} != {b}", len(left)
    return "", len(left)


def main():
    import __spark_entry__ as entry
    from pressline.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                problem, n = compare(run(spark, folder), con, sql[name])
            else:
                problem, n = "", len(run(spark, folder).toPandas())
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[-700:] if "PythonException" in repr(error)[:30] else str(error)[:600]}", -1
        failed += bool(problem)
        state = "FAIL" if problem else ("ok" if name in sql else "rows-only")
        print(f"{state:9} {name:40} {n:8} rows {time.time() - start:6.1f}s {problem}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
