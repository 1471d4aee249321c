"""Every registered query against its SQL oracle (small scale) and plan checks."""

import pytest

import __spark_entry__ as entry
from flowlab.plans.catalog import QUERIES as CATALOG
from flowlab.plans.oracle import ORACLE as FLOW_ORACLE
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare_one, duck

# the flow queries; other parts that the entry adds have tests of their own
QUERIES = dict(CATALOG)
ORACLE = dict(FLOW_ORACLE)


def test_every_query_has_an_oracle_or_is_listed():
    missing = set(QUERIES) - set(ORACLE)
    assert not missing, missing
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["src_ip", "avg_up_bytes_normal", "avg_down_bytes_normal",
                          "avg_up_bytes_test", "avg_down_bytes_test"]
    assert df.count() == 6  # calibrated at sf0.001


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    info = compare_one(spark, con, key, QUERIES[key], ORACLE[key], SF_SMALL)
    assert info["ok"], info


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_has_no_python_or_nested_loops(spark, key):
    plan = QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, (key, bad)


def test_filters_reach_the_parquet_scan(spark):
    plan = QUERIES["to_internet_flows"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "StringStartsWith(dst_ip,192.168.109.)" in plan
    plan = QUERIES["detect_quic_exfil"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan
