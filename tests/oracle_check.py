"""Compare registered queries with their SQL: ``python tests/oracle_check.py [folder] [query ...]``."""

import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 5)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, connection, folder, name, build, sql):
    """(rows, difference or None) of one query against its SQL."""
    df = build(spark, folder)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return sum(got.values()), None
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return sum(got.values()), f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        extra, lacking = got - want, want - got
        return sum(got.values()), (
            f"{sum(got.values())} vs {sum(want.values())} rows; only Spark {list(extra)[:3]}; only SQL {list(lacking)[:3]}"
        )
    return sum(got.values()), None


def views(folder):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET enable_progress_bar = false")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:] or list(queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    connection, sql = views(folder), oracle_sql()
    for name in wanted:
        start = time.time()
        try:
            n, difference = compare(spark, connection, folder, name, queries()[name], sql.get(name))
            verdict = "ok" if difference is None else f"DIFF {difference}"
            if name not in sql:
                verdict += " (rows only)"
        except Exception as error:  # noqa: BLE001
            n, verdict = "-", f"ERROR {str(error)[:700]}"
        print(f"{name:26} {n!s:>8} {time.time() - start:6.1f}s {verdict}", flush=True)
