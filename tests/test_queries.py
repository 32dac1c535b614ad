"""Every registered query against its SQL over whole tables."""

import duckdb
import pytest

import __spark_entry__ as contract
import tidemark.plans.queries  # noqa: F401
from oracle import connect, spark_digest, sql_digest
from tidemark.plans.queries.registry import spark_queries, sql_queries

QUERIES = spark_queries()
ORACLES = sql_queries()


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, folder, name):
    frame = QUERIES[name](spark, folder)
    found = spark_digest(frame)
    assert found[1] > 0
    if name in ORACLES:
        wanted = sql_digest(connection, ORACLES[name])
        assert found[0] == wanted[0]
        assert found[1] == wanted[1]
        if found[2] != wanted[2]:
            pairs = [(f, w) for f, w in zip(found[3], wanted[3]) if f != w]
            raise AssertionError(f"{len(pairs)} rows differ, first: {pairs[:3]}")


def test_oracles_have_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())


def test_json_events_with_whole_seconds(spark, tmp_path):
    events = spark.sql(
        """
        select id as event_id, id as user_id, 'view' as event_type, 1.5D as value,
               case id when 0 then timestamp_ntz '2024-01-02 03:04:05' when 1 then timestamp_ntz '2024-01-02 03:04:05.5' end as ts
        from range(3)
        """
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    connection = duckdb.connect()
    connection.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    found = spark_digest(QUERIES["json_events"](spark, str(tmp_path)))
    assert found == sql_digest(connection, ORACLES["json_events"])
