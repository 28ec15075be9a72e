"""Counts of tiles against the tiles themselves."""

from graniteflow.functions import geometry as g
from graniteflow.plans.regions import first_three_near
from graniteflow.plans.tiling import regions
from pyspark.sql import functions as F


def test_adaptive_count_is_that_of_the_tiles(spark):
    w, h = (F.col("id") * 37 % 9000 + 1).cast("int"), (F.col("id") * 53 % 12000 + 1).cast("int")
    sheets = spark.range(4000).select(w.alias("w"), h.alias("h"), (F.col("id") % 40 / 100).alias("d"))
    args = [F.col(c) for c in "whd"]
    rows = sheets.select("w", "h", "d", g.adaptive_count(*args).alias("c"), g.adaptive_tiles(*args).alias("t"))
    pixels = F.aggregate("t", F.lit(0).cast("long"), lambda n, t: n + t["width"] * t["height"])
    assert rows.where((F.col("c.n") != F.size("t")) | (F.col("c.pixels") != pixels)).count() == 0


def test_regions_are_dealt_over_the_tasks_of_a_shuffle(spark):
    assert regions(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_near_regions_are_joined_once_over_all_tasks(spark):
    plan = first_three_near(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("REPARTITION_BY_NUM") >= 3
