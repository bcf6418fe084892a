"""Runs registered queries and their SQL side by side. As a script: oracle.py FOLDER [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if hasattr(value, "tolist"):
        return canonical(value.tolist())
    return value


def rows_of(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(canonical(v) for v in row) for row in zip(*columns)]
    return names, sorted(rows, key=repr)


def compare(spark, con, folder: str, name: str) -> tuple[str, float, int]:
    from siftwell.queries import ORACLES, QUERIES

    start = time.time()
    got = QUERIES[name](spark, folder).toArrow()
    seconds = time.time() - start
    if name not in ORACLES:
        return ("rows only" if got.num_rows else "EMPTY"), seconds, got.num_rows
    want = con.sql(ORACLES[name]).to_arrow_table()
    (got_names, got_rows), (want_names, want_rows) = rows_of(got), rows_of(want)
    if got_names != want_names:
        return f"COLUMNS {got_names} != {want_names}", seconds, got.num_rows
    types = {n: (str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in got_names}
    odd = {n: t for n, t in types.items() if t[0].removeprefix("large_") != t[1].removeprefix("large_")}
    if got_rows != want_rows:
        diff = [(a, b) for a, b in zip(got_rows, want_rows) if a != b][:2]
        return f"DIFFERENT {len(got_rows)} / {len(want_rows)} {str(diff)[:600]} {odd}", seconds, got.num_rows
    return f"ok {odd or ''}", seconds, got.num_rows


if __name__ == "__main__":
    from siftwell.queries import QUERIES
    from siftwell.session import build_session

    folder, *names = sys.argv[1:]
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in names or QUERIES:
        try:
            verdict, seconds, n = compare(spark, con, folder, name)
        except Exception as error:
            verdict, seconds, n = f"ERROR {str(error)[:1500]}", 0.0, 0
        print(f"{name:28s} {seconds:7.2f}s {n:8d} {verdict}", flush=True)
