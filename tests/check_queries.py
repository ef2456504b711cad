"""Run registered queries next to their SQL texts in DuckDB and compare the rows.

Usage: python tests/check_queries.py [--sf DIR] [--only NAME_PREFIX ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

import os

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def canonical_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", nargs="*", default=None)
    args = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    oracles = entry_module.oracle_sql()
    bad = 0
    for name, fn in entry_module.queries().items():
        if args.only and not any(name.startswith(p) for p in args.only):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            got_columns, got = canonical_rows(df.columns, df.collect())
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            start = time.time()
            cur = con.execute(oracles[name])
            want_columns, want = canonical_rows([d[0] for d in cur.description], cur.fetchall())
            sql_took = time.time() - start
        except Exception as err:
            bad += 1
            print(f"ERROR {name}: {type(err).__name__} {str(err)[:700]}", flush=True)
            continue
        if got_columns != want_columns:
            bad += 1
            print(f"FAIL  {name}: columns {got_columns} vs {want_columns}", flush=True)
        elif got != want:
            bad += 1
            extra, lacking = set(got) - set(want), set(want) - set(got)
            only_got, only_want = sorted(extra)[:3], sorted(lacking)[:3]
            print(f"FAIL  {name}: {len(got)} vs {len(want)} rows, {len(extra)} differ\n  columns {got_columns}\n  got  {only_got}\n  want {only_want}", flush=True)
        else:
            print(f"ok    {name}: {len(got)} rows {took:.1f}s (sql {sql_took:.1f}s)", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
