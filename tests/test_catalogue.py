"""Every catalogue query against its SQL."""

import collections
import math

import duckdb
import pytest

import __spark_entry__
from keyspan.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(value):
    """Numbers alike whatever their type, rounded where they are not whole."""
    if isinstance(value, bool) or value is None:
        return value
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    return None if math.isnan(number) else round(number, 9)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    found = collections.Counter(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    if name not in catalogue.ORACLE_SQL:
        assert found
        return
    result = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    assert found == collections.Counter(tuple(plain(v) for _, v in sorted(zip(names, r), key=lambda x: x[0])) for r in result.fetchall())


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_filters_and_columns_down(spark):
    plan = catalogue.QUERIES["range_scan_half_open"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,100), LessThan(o_orderkey,200)]" in plan and "o_totalprice" not in plan
    latest = catalogue.QUERIES["mvcc_latest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in latest and "Window" not in latest
    assert "NestedLoop" not in catalogue.QUERIES["join_on_equi"](spark, SF)._jdf.queryExecution().executedPlan().toString()


WHOLE = "lock_conflict_pairs wound_wait_decision refresh_conflicts range_locate range_table_stats rebalance_choice span_overlap closed_timestamp_publish".split()


@pytest.mark.parametrize("name", WHOLE)
def test_query_takes_all_rows(spark, name):
    """Against its SQL on a larger table."""
    larger, con = SF.replace("0.001", "0.01"), duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{larger}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, larger)
    found = collections.Counter(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    result = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert found == collections.Counter(tuple(plain(v) for _, v in sorted(zip(names, r), key=lambda x: x[0])) for r in result.fetchall())


def test_refresh_conflicts_with_late_writes(spark):
    larger, con = SF.replace("0.001", "0.1"), duckdb.connect()
    writes = dict(con.sql(f"select o_orderkey, o_custkey from '{larger}/orders.parquet'").fetchall())
    keys = [k for k, in con.sql(f"select c_custkey from '{larger}/customer.parquet'").fetchall()]
    want = {str(k) for k in keys if any(k < writes.get(x, k) <= k + 40 for x in range(k, k + 5))}
    assert max(map(int, want)) >= 2000
    assert {r["txn_id"] for r in catalogue.QUERIES["refresh_conflicts"](spark, larger).collect()} == want
