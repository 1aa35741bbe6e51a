"""Compare registered queries with their SQL in DuckDB: ``check_oracles.py [sf] [query ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, pd.Timestamp):
        return str(value)
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = [tuple(_plain(v) for v in row) for row in frame.itertuples(index=False)]
    return sorted(plain, key=repr)


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> list[str]:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"]
    if len(spark_frame) != len(sql_frame):
        return [f"{len(spark_frame)} rows != {len(sql_frame)} rows"]
    pairs = zip(rows(spark_frame), rows(sql_frame), strict=True)
    return [f"{a} != {b}" for a, b in pairs if a != b]


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    sql = contract.oracle_sql()
    failed = 0
    for name, run in contract.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.perf_counter()
        try:
            result = run(spark, sf_dir)
            frame = result.toPandas()
            took = time.perf_counter() - started
            if name not in sql:
                print(f"rows  {name:24} {len(frame):8} rows {took:6.2f}s", flush=True)
                continue
            expected = db.sql(sql[name])
            found = differences(frame, expected.df())
            types = dict(result.dtypes), dict(zip(expected.columns, map(str, expected.types)))
            print(f"{'FAIL' if found else 'ok':5} {name:24} {len(frame):8} rows {took:6.2f}s", flush=True)
            if found:
                failed += 1
                print("   ", len(found), found[:3], types, flush=True)
        except Exception as error:
            failed += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
