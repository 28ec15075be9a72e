"""Texts inside texts against a double loop."""

import random

from graniteflow.operators.containment import contained
from graniteflow.plans.containing import inferred_tiles


def test_contained(spark):
    rnd = random.Random(6)
    text = lambda most: "".join(rnd.choice("KLZ1") for _ in range(rnd.randint(0, most)))
    parts = [(rnd.randrange(2), text(4)) for _ in range(120)] + [(0, None), (None, "K"), (0, "日"), (0, "x")]
    wholes = [(rnd.randrange(2), text(9)) for _ in range(120)] + [(0, None), (None, "KL"), (0, "本日本"), (0, "KZ 1")]
    want = {(g, p, w) for g, p in parts for h, w in wholes if g is not None and g == h and p and w and p in w}
    found = contained(spark.createDataFrame(parts, "g int, part string"), spark.createDataFrame(wholes, "g int, whole string"), ("g",)).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    none = spark.createDataFrame([], "part string")
    assert contained(none, spark.createDataFrame([("a",)], "whole string")).count() == 0
    whole_table = contained(spark.createDataFrame([("ab",)], "part string"), spark.createDataFrame([("xaby",), ("ba",)], "whole string"))
    assert [tuple(r) for r in whole_table.collect()] == [("ab", "xaby")]


def test_nothing_is_sent_to_the_driver_however_small_a_table_looks(spark):
    plan = inferred_tiles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
