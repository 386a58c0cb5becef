"""Every named query against its SQL on another engine, and the shape of the plans."""

import pytest

from __spark_entry__ import entry
from berthline.plans.catalog import ORACLES, QUERIES
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
EAGER = {n for n in QUERIES if n.startswith(("stream_", "train_", "search_")) or n in ("batch_assign", "early_stopping")}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, duck, name):
    assert compare(spark, duck, SF, name) is None


def test_entry(spark):
    assert entry(spark).count() == 1500


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plans_have_no_pairwise_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_batch_assign_never_books_a_machine_twice(spark):
    won = QUERIES["batch_assign"](spark, SF).filter("machine_id IS NOT NULL")
    assert won.count() == won.select("arrival_ms", "machine_id").distinct().count() > 0
