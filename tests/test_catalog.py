from __future__ import annotations

import pytest

from codeloom import catalog
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    columns, rows = oracle.spark_rows(catalog.QUERIES[name](spark, sf_dir))
    want_columns, want = oracle.duck_rows(con, catalog.ORACLE_SQL[name])
    assert columns == want_columns
    assert len(rows) == len(want)
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["graph_page", "resolve_calls_ranked", "reexport_two_hop", "symbol_search", "candidate_dedup_cap"])
def test_partition_count_does_not_matter(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = oracle.spark_rows(catalog.QUERIES[name](spark, sf_dir))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert one == oracle.spark_rows(catalog.QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalog.QUERIES["graph_nodes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "l_linestatus" in x and "FileScan" in x)
    assert "EqualTo(l_linestatus,O)" in scan and "In(l_returnflag, [A,N])" in scan
    assert "l_tax" not in scan and "l_extendedprice" not in scan


@pytest.mark.parametrize("name", ["suffix_join", "prefix_join", "path_suffix_join", "resolve_calls_ranked", "edges_touching"])
def test_no_nested_loop_over_tables(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
