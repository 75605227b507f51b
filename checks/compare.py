"""Run registered queries and their SQL side by side: ``python -m checks.compare [sf_dir] [name-part ...]``."""

from __future__ import annotations

import hashlib
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks import ALL_QUERIES, ALL_SQL
from checks.fixtures import TABLE_NAMES
from checks.registry import INVARIANTS


def canonical(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    return list(frame.columns), sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def digest(rows: list[tuple]) -> str:
    return hashlib.sha256(repr(rows).encode()).hexdigest()[:12]


def compare(spark: SparkSession, sf_dir: str, name: str, con) -> tuple[bool, str]:
    started = time.time()
    frame = ALL_QUERIES[name](spark, sf_dir)
    got = frame.toPandas()
    took = f"{time.time() - started:5.1f}s"
    if name not in ALL_SQL:
        kept = bool(INVARIANTS[name](got.to_dict("records"), spark, sf_dir))
        return kept, f"{took} {len(got)} rows (invariant{'' if kept else ' broken'})"
    expected = con.execute(ALL_SQL[name]).df()
    columns, rows = canonical(got)
    want_columns, want = canonical(expected)
    if columns != want_columns:
        return False, f"{took} columns {columns} != {want_columns}"
    if digest(rows) != digest(want):
        diff = list(set(rows) ^ set(want))
        return False, f"{took} {len(rows)} vs {len(want)} rows, {len(diff)} differ: {columns} {sorted(diff)[:4]}"
    kinds = {c: (got[c].dtype.kind, expected[c].dtype.kind) for c in columns if got[c].dtype.kind != expected[c].dtype.kind}
    sizes = {c: (str(got[c].dtype), str(expected[c].dtype)) for c in columns if str(got[c].dtype) != str(expected[c].dtype)}
    return True, f"{took} {len(rows)} rows" + (f" KIND {kinds}" if kinds else f" dtype {sizes}" if sizes else "")


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLE_NAMES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    failed = []
    for name in sorted(ALL_QUERIES):
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, note = compare(spark, sf_dir, name, con)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
