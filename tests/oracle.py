"""Runs queries beside their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(rows, key=repr)


def spark_rows(df):
    return _normal(df.columns, df.collect())


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return _normal(names, cursor.fetchall())


def compare(spark, con, name, query, sql, sf_dir):
    """None if both sides agree, else what differs."""
    columns, rows = spark_rows(query(spark, sf_dir))
    want_columns, want = duck_rows(con, sql)
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if rows != want:
        extra = [r for r in rows if r not in set(want)][:2] if len(rows) < 200_000 else []
        missing = [r for r in want if r not in set(rows)][:2] if len(rows) < 200_000 else []
        return f"rows {len(rows)} vs {len(want)}; only here {str(extra)[:700]}; only in SQL {str(missing)[:700]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from sourcelake.session import local_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark, con = local_session("oracle", 8), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in only or queries:
        start = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracles[name], sf_dir)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
