"""Chosen houses: how its joins are planned."""

import os

import pytest

from placeloom.plans import answer_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_chosen_houses_broadcasts_neither_plans_nor_addresses(spark):
    """o8: queries and addresses grow with the data."""
    plan = answer_queries.o8(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [query_id" not in plan and "BroadcastHashJoin [doc" not in plan
