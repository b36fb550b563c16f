"""Every job against its SQL in DuckDB, on the given tables and on a copy in which single keys hold a third of all rows."""

import pytest

from clickmart_checks import jobs, oracles
from clickmart_checks.compare import TABLES, differences, duck

PLAIN = "/root/testdata/sf0.001"

# One user on one day, one order and one product get a third of the rows; line ids stay unique by their supplier.
HOT = {
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id, "
    "CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' + event_id * INTERVAL '7' SECOND ELSE ts END "
    "AS ts) FROM events",
    "lineitem": "SELECT * REPLACE (CASE WHEN hash(l_extendedprice) % 3 = 0 THEN 1 ELSE l_orderkey END AS l_orderkey, "
    "CASE WHEN hash(l_suppkey, l_extendedprice) % 3 = 0 THEN 2 ELSE l_partkey END AS l_partkey, "
    "row_number() OVER () AS l_suppkey, "
    "CASE WHEN hash(l_extendedprice) % 5 = 0 THEN 'R' ELSE l_returnflag END AS l_returnflag) FROM lineitem",
}


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    connection = duck(PLAIN)
    for table in TABLES:
        rows = HOT.get(table, f"SELECT * FROM {table}")
        connection.execute(f"COPY ({rows}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    copy = duck(str(folder))
    for table, key in (("events", "user_id"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey")):
        share = f"SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM {table} GROUP BY {key})"
        assert copy.execute(share).fetchall()[0][0] > 0.3
    return str(folder)


@pytest.fixture(scope="module")
def like_large_tables(spark):
    """No broadcast, and adaptive execution that splits even small partitions."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


def test_every_job_has_sql():
    assert set(jobs.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", list(jobs.queries()))
def test_job(spark, name):
    assert differences(jobs.queries()[name](spark, PLAIN), oracles.oracle_sql()[name], duck(PLAIN)) == []


@pytest.mark.parametrize("name", list(jobs.queries()))
def test_job_with_hot_keys(spark, like_large_tables, hot_dir, name):
    assert differences(jobs.queries()[name](spark, hot_dir), oracles.oracle_sql()[name], duck(hot_dir)) == []


@pytest.mark.parametrize("name", ["source_campaign_segments", "landing_page_performance"])
def test_job_with_floors_that_leave_rows(spark, monkeypatch, name):
    for module in (jobs, oracles):
        monkeypatch.setattr(module, "MIN_CAMPAIGN_SESSIONS", 20)
        monkeypatch.setattr(module, "MIN_LANDING_SESSIONS", 70)
    df = jobs.queries()[name](spark, PLAIN)
    assert 0 < df.count() and differences(df, oracles.oracle_sql()[name], duck(PLAIN)) == []


@pytest.mark.parametrize("name", [name for name in jobs.queries() if name.endswith("_flawed")])
def test_flaws_are_found(spark, name):
    """Every number that a check reports is above zero."""
    for row in jobs.queries()[name](spark, "/root/testdata/sf0.01").collect():
        assert all(value > 0 for value in row if not isinstance(value, str)), row
