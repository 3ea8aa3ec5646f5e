"""Run registered queries next to DuckDB and compare columns, row counts and values."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dumpdeck.plans.registry import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, decimal.Decimal):
        return format(v, "f")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, run, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = run(spark, sf_dir)
    mine = _rows(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = _rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    if [list(map(type, r)) for r in mine[:1]] != [list(map(type, r)) for r in theirs[:1]]:
        return f"types: {mine[:1]} against {theirs[:1]}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a!r} against {b!r}"[:600]
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from dumpdeck import build_session

    sf, only = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        started = time.monotonic()
        try:
            if name in oracles:
                said = compare(spark, con, sf, run, oracles[name]) or "ok"
            else:
                said = f"rows only: {run(spark, sf).count()}"
        except Exception as e:
            said = "FAILED " + str(e).strip()[:700]
        print(f"{name:28s} {time.monotonic() - started:6.2f}s {said}", flush=True)
