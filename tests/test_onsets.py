"""Onsets of laps as arrays, not as a group of Pandas rows each."""

from tracespark.plans import QUERIES


def test_laps_are_packed(spark):
    plan = QUERIES["b4_run_onsets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
