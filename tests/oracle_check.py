"""Run registered queries next to their SQL: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, sf_dir, names=None):
    """Yields (name, problem or None, number of rows, seconds of Spark, seconds of SQL)."""
    import duckdb

    import __spark_entry__ as entry

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if name not in sql or (names and name not in names):
            continue
        start = time.time()
        frame = query(spark, sf_dir)
        found = rows_of(frame.columns, frame.collect())
        middle = time.time()
        result = connection.execute(sql[name])
        columns = [column[0] for column in result.description]
        expected = rows_of(columns, result.fetchall())
        end = time.time()
        problem = None
        if sorted(columns) != sorted(frame.columns):
            problem = f"columns {frame.columns} instead of {columns}"
        elif found != expected:
            missing = [row for row in expected if row not in set(found)][:2] if len(expected) < 10**5 else []
            problem = f"{len(found)} rows instead of {len(expected)}; missing {missing}"
        yield name, problem, len(found), middle - start, end - middle


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    for name, problem, rows, spark_time, sql_time in compare(
        session, f"/root/testdata/sf{scale}", sys.argv[2:]
    ):
        print(f"{name:34} {rows:8} {spark_time:7.2f} {sql_time:7.2f} {problem or 'ok'}"[:400], flush=True)
