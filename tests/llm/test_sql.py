"""The SQL for DuckDB against the operators, on odd rows and on a whole small table."""

import duckdb
import pytest

from clickmart.llm import queries
from tests.llm.conftest import BASE, ODD, PLAIN

ROWS = [
    *ODD,
    (20, "lorem IPSUM " + BASE),
    (21, BASE + "\nmore words that trail off...  \nagain some words that do…\t\nand one that ends"),
    (22, BASE + " javascript is disabled"),
    (23, BASE + " xjavascript is disabled"),
    (24, BASE + " " + "é" * 3000),
    (25, " ".join(f"w{i % 9}" for i in range(40))),
    (26, " A line that several have \nown line of 26\n\x1ca line that several have"),
    (27, "a line that SEVERAL have\t\nown line of 27"),
    (None, "a line that several have"),
]


def compared(df, sql, connection):
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    wanted = sorted((tuple(row) for row in cursor.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(row) for row in df.select(*names).collect()), key=repr) == wanted
    return wanted


@pytest.mark.parametrize("name", ["op3_line_dedup", "op4_quality_rules"])
def test_odd_rows(spark, as_documents, tmp_path, name):
    as_documents(ROWS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = compared(queries.queries()[name](spark, str(tmp_path)), queries.oracle_sql()[name], connection)
    assert len(found) == len(ROWS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_whole_small_table(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{PLAIN}/{table}.parquet'")
    compared(queries.queries()[name](spark, PLAIN), queries.oracle_sql()[name], connection)
