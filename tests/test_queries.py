"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quadlake.bindings.registry import QUERIES as REGISTERED
from tools.compare import TABLES, canon

FOLDER = "/root/testdata/sf0.001"
OWN = set(REGISTERED)  # operators with a test folder of their own are left to it
QUERIES = {k: v for k, v in entry.queries().items() if k in OWN}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    cur = duck.execute(ORACLES[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_no_pairwise_joins_and_no_python(spark):
    """No plan pairs up whole tables, and no row goes through Python."""
    for name, build in QUERIES.items():
        if name.startswith("stream_"):
            continue
        plan = build(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                     "MapInPandas", "FlatMapGroupsInPandas"):
            assert node not in plan, (name, node)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["scan_project"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,250000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_reward_rules_stay_off_the_driver(spark):
    plan = QUERIES["explode_rules_load"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
