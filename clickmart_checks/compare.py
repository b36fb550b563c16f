"""Run every job in Spark and its SQL in DuckDB and compare columns, types, rows and values.

python -m clickmart_checks.compare [sf_dir] [job ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from clickmart_checks import jobs, oracles

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def local_session(cpus: str = "8", app: str = "clickmart-checks") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def _duck_type(kind: str) -> str:
    return {
        "BIGINT": "bigint",
        "INTEGER": "int",
        "VARCHAR": "string",
        "TIMESTAMP": "timestamp_ntz",
        "DATE": "date",
        "BOOLEAN": "boolean",
        "DOUBLE": "double",
    }.get(kind, kind.lower())


def differences(df: DataFrame, sql: str, connection: duckdb.DuckDBPyConnection) -> list[str]:
    """What differs between the Spark result and the SQL result; empty if nothing does."""
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    kinds = {column[0]: _duck_type(str(column[1])) for column in cursor.description}
    expected = _rows(names, cursor.fetchall())
    actual = _rows(df.columns, [tuple(row) for row in df.collect()])
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    found += [f"type of {name}: {kind} instead of {kinds[name]}" for name, kind in df.dtypes if kind != kinds[name]]
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows instead of {len(expected)}")
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0][0]} instead of {wrong[0][1]}")
    return found


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark, connection = local_session(), duck(sf_dir)
    queries, sql = jobs.queries(), oracles.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            found = differences(df, sql[name], connection)
            size = "" if found else f"{df.count()} rows"
        except Exception as error:  # report and go on with the next job
            found, size = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name:32s} {time.time() - start:5.1f}s {size}", *found, sep="\n     " if found else " ")
    print(f"{failed} failed; without SQL: {sorted(set(queries) - set(sql))}; without job: {sorted(set(sql) - set(queries))}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
