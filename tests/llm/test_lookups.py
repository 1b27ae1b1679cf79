"""Lookups of hot keys: copies are made only where rows are shuffled."""

import random

import pytest

from casegraph.llm.common import salted_join, stored


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_a_broadcast_lookup_has_no_copies(spark, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        rng = random.Random(1)
        rows = [(rng.choice([None, 1, 1, 1, 2, 5]), i) for i in range(50)]
        lookup = stored(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k bigint, v string"), "lookup")
        found = salted_join(spark.createDataFrame(rows, "k bigint, i bigint"), lookup, ["k"])
        assert sorted(tuple(r) for r in found.collect()) == sorted((k, i, {1: "a", 2: "b"}[k]) for k, i in rows if k in (1, 2))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("explode" in plan) == (limit == "-1")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
