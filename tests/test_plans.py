"""What the physical plan does: shuffles, pruning, pushed filters."""

import re

import pytest

from monthmatch.fixed_values import MATCH_KEY
from monthmatch.operators.skew import NO_HEAVY_KEYS, HeavyKeys, key_hash
from monthmatch.plans.reconcile import reconcile
from workloads import fixture

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def shuffles(plan):
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_one_shuffle_per_input(spark, no_broadcast):
    i = fixture.inputs(spark, SF_DIR)
    plan = plan_of(
        reconcile(i.current, i.prior_raw, i.prior_clean, "IND", i.open_unl, heavy=NO_HEAVY_KEYS)
    )
    assert shuffles(plan) == 4
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    # Lookups lose all but one row per key and map task before their shuffle.
    assert plan.count("WindowGroupLimit") >= 4


def test_heavy_rows_are_not_shuffled_for_lookups(spark, no_broadcast):
    i = fixture.inputs(spark, SF_DIR)
    keys = [*MATCH_KEY, "DisbursementDate"]
    some = i.current.select(key_hash(MATCH_KEY), key_hash(keys)).limit(5).collect()
    heavy = HeavyKeys(tuple(r[0] for r in some), tuple(r[1] for r in some))
    plan = plan_of(
        reconcile(i.current, i.prior_raw, i.prior_clean, "IND", i.open_unl, heavy=heavy)
    )
    # One broadcast for the duplicates' winners and one for each lookup, besides
    # those of the heavy keys themselves.
    joins = [line for line in plan.split("Initial Plan")[0].splitlines() if "BroadcastHashJoin" in line]
    assert len([line for line in joins if "_heavy" not in line]) == 4 and "CartesianProduct" not in plan
    assert all("LeftSemi" in line or "LeftAnti" in line for line in joins if "_heavy" in line)


def test_no_python_in_the_plan(spark):
    i = fixture.inputs(spark, SF_DIR)
    plan = plan_of(reconcile(i.current, i.prior_raw, i.prior_clean, "IND", i.open_unl))
    assert "Python" not in plan and "Arrow" not in plan


def test_scan_reads_only_the_columns_needed(spark):
    i = fixture.inputs(spark, SF_DIR)
    plan = plan_of(
        reconcile(i.current, i.prior_raw, i.prior_clean, "IND", i.open_unl, heavy=NO_HEAVY_KEYS).select(
            "IdentityKey", "IsDuplicate"
        )
    )
    assert "c_name" not in plan and "c_mktsegment" not in plan
