"""Run the registered queries beside their SQL and report differences.

Usage: python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if value != value else round(value + 0.0, 6) + 0.0
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, folder: str, name: str, query, sql: str | None) -> tuple[int, str]:
    got = query(spark, folder)
    mine = rows_of(got.columns, [tuple(r) for r in got.collect()])
    if sql is None:
        return len(mine), "no SQL"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(got.columns):
        return len(mine), f"columns differ: {sorted(got.columns)} / {sorted(names)}"
    if mine != theirs:
        only_mine = [r for r in mine if r not in set(theirs)][:2]
        only_theirs = [r for r in theirs if r not in set(mine)][:2]
        return len(mine), f"rows differ ({len(mine)} / {len(theirs)}): {only_mine} / {only_theirs}"
    return len(mine), ""


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from opsreview.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), oracle_sql()
    for name, query in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            n, problem = difference(spark, con, folder, name, query, sql.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            n, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:32s} {n:7d} rows {time.time() - start:6.1f}s  {problem or 'same'}", flush=True)
