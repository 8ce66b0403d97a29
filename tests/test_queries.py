"""Every query with SQL gives the SQL's rows; the others run and have a stable schema."""

from __future__ import annotations

import pytest
from compare import difference, duck

from gridloom.plans.queries import catalogue

QUERIES, SQL = catalogue()


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, con, name):
    assert difference(QUERIES[name](spark, data), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns == QUERIES[name](spark, data).columns
    assert df.count() > 0


def test_raw_and_regional_topk_agree(spark, data):
    from gridloom.operators import topk
    from gridloom.sources.catalog import Catalog

    for shape in ("event_value_desc", "tenant_day_sum", "user_count"):
        raw, pushed = (topk.topk(Catalog(spark, data), shape, 15, ("eu", "us", "apac"), p).collect() for p in (False, True))
        assert raw == pushed
    with pytest.raises(ValueError):
        topk.topk(Catalog(spark, data), "no_such_shape", 5)


def test_colocated_and_repartition_pairs_agree(spark, data):
    for a, b in (("gac_fdw_n3_colocated_user_join", "gac_fdw_n3_repartition_user_join"), ("sr_q11_colocated_user_join_pair", "sr_q12_repartition_user_join_pair")):
        assert QUERIES[a](spark, data).collect() == QUERIES[b](spark, data).collect()


def test_no_query_reads_the_clock():
    from gridloom.plans.control import clock_functions

    assert not [name for name, sql in SQL.items() if clock_functions(sql)]


def test_filters_reach_the_scan(spark, data):
    from gridloom.plans.profile import pushed_filters

    assert any("GreaterThanOrEqual(value" in f for f in pushed_filters(QUERIES["sr_q03_event_filter_summary"](spark, data)))


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
