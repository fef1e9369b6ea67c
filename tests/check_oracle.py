"""Compare registered queries with their SQL twins: python tests/check_oracle.py SF_DIR [name ...]."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, (int, float)):
        return round(float(value), 9)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    return value


def table_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(canon(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    left = table_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    right = table_of([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} vs {len(right[1])}"
    for a, b in zip(left[1], right[1], strict=True):
        if a != b:
            cells = [(c, x, y) for c, x, y in zip(left[0], a, b, strict=True) if x != y]
            return f"{a[:3]}: {cells[:6]}"
    return None


def main() -> None:
    from threadline.plans import registry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "10g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = registry.queries(), registry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if names and not any(n in name for n in names):
            continue
        began = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracle:
                problem = difference(df, con, oracle[name])
                rows = ""
            else:
                rows, problem = f" rows={df.count()} (no twin)", None
        except Exception as exc:  # noqa: BLE001
            problem, rows = f"{type(exc).__name__}: {str(exc)[:600]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.2f}s{rows} {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
