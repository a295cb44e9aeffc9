"""Run registered queries next to their SQL and compare row counts, columns and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("daygrid")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}" if value != 0 else "0"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**31 else str(value)
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    t = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spark_time = time.time() - t
    if sql is None:
        return f"rows {len(rows)}", spark_time, 0.0, []
    t = time.time()
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    expected = cur.fetchall()
    sql_time = time.time() - t
    notes = []
    if sorted(columns) != sorted(df.columns):
        notes.append(f"columns {sorted(df.columns)} <> {sorted(columns)}")
    got, want = table_of(df.columns, rows), table_of(columns, expected)
    if got != want:
        missing = sorted(set(want) - set(got))[:3]
        extra = sorted(set(got) - set(want))[:3]
        notes.append(f"rows {len(got)} <> {len(want)}; only sql {missing}; only spark {extra}")
    return ("ok" if not notes else "DIFF") + f" {len(rows)}", spark_time, sql_time, notes


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    from daygrid.catalog import ORACLES, QUERIES

    spark, con = session(), duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, st, dt, notes = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            status, st, dt, notes = "ERROR", 0.0, 0.0, [str(e)[:900]]
        bad += bool(notes)
        print(f"{name:38s} {status:12s} spark {st:6.1f}s sql {dt:5.1f}s", flush=True)
        for n in notes:
            print("    ", n[:1500], flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
