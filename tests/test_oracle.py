"""Every query with a SQL twin returns the same rows; plans stay free of pairwise joins."""

import pytest

import __spark_entry__ as entry
import check_oracle


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check_oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, sf_dir, name):
    assert check_oracle.compare(spark, duck, name, sf_dir) is None


PLAIN = [n for n in sorted(entry.oracle_sql()) if not n.startswith(("boosted", "knn", "save"))]


@pytest.mark.parametrize("name", PLAIN)
def test_plan_has_no_pairwise_join(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_the_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["c_custkey", "day"] and df.count() > 0
