"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, connect
from commutelens.plans.oracles import ORACLES as SQL
from commutelens.plans.queries import QUERIES
from commutelens.session import scratch


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    with scratch(spark):
        df = QUERIES[name](spark, sf_dir)
        verdict, _ = compare(df, con, SQL[name])
        assert verdict == "ok", verdict
        plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan


def test_sql_for_each_query():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert [r.scenario for r in rows] == ["baseline", "donothing", "optimal", "pasfor"]
    assert all(r.people_critical > 0 for r in rows)
