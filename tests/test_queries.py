import pytest
from oracle import DATA, check

from fieldglass.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    check(spark, QUERIES[name], ORACLE[name])


def test_simulation_query_repeats_itself(spark):
    a, b = (QUERIES["simulate_candidates"](spark, DATA).collect() for _ in range(2))
    assert a == b and len(a) == 10 and all(r.n_simulations == 200 for r in a)


def test_simulation_takes_the_whole_pool(spark, monkeypatch):
    from fieldglass.plans import simulate

    monkeypatch.setattr(simulate, "simulate_candidates", lambda spark, snap, candidates, n, chunk: snap)
    folder = "/root/testdata/sf0.01"
    assert len(QUERIES["simulate_candidates"](spark, folder).ids) == spark.read.parquet(f"{folder}/customer.parquet").count() > 300


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_columns_reach_the_scan(spark):
    plan = QUERIES["vor"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "c_nationkey" not in plan and "Python" not in plan


def test_filters_reach_the_scan(spark):
    plan = QUERIES["projections_and_filters"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(c_mktsegment" in plan
