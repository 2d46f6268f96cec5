"""Runs a registered plan on Spark and its twin on DuckDB and compares whole results.

    python tests/oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from querylore.sources.views import BASE_TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("null",) if math.isnan(value) else ("float", float(f"{value:.12g}"))
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return ("time", str(value))
    if isinstance(value, (list, tuple)):
        return ("list", tuple(_plain(v) for v in value))
    return ("str", str(value))


def table(names, rows) -> tuple[tuple[str, ...], list]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return tuple(names[i] for i in order), sorted(out, key=repr)


def run_duckdb(con, sql: str):
    result = con.sql(sql)
    return table(result.columns, result.fetchall())


def run_spark(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def difference(spark_table, duck_table) -> str | None:
    """None when equal, else a short text."""
    (sc, sr), (dc, dr) = spark_table, duck_table
    if sc != dc:
        return f"columns {sc} / {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} / {len(dr)}; only spark {[r for r in sr if r not in dr][:2]} only duckdb {[r for r in dr if r not in sr][:2]}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    return f"{len(bad)} of {len(sr)} rows differ, first {bad[0]}"[:1500] if bad else None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from querylore.session import local_session

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(folder)
    sqls, failed = oracle_sql(), 0
    for name, build in queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        started = time.time()
        try:
            got = run_spark(build(spark, folder))
            spark_s, started = time.time() - started, time.time()
            if name in sqls:
                want = run_duckdb(con, sqls[name])
                text = difference(got, want)
            else:
                text = None
            note = "" if name in sqls else " (no twin)"
            print(f"{'FAIL' if text else 'ok  '} {name}{note} rows={len(got[1])} spark={spark_s:.1f}s duckdb={time.time() - started:.1f}s {text or ''}", flush=True)
            failed += bool(text)
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name} {type(error).__name__}: {str(error)[:700]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
