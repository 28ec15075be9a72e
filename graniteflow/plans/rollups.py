"""Roll-ups over components and fusion candidates. All aggregates combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.plans.takeoff import COMPONENTS_SQL, components
from graniteflow.session import table

VOLUME = "length * width * height"
SUMS_SQL = "count(*) AS n, round(sum(quantity), 3) AS total_quantity, round(sum(length * width * height), 1) AS total_volume"
#: Weight of a candidate's source in the weighted confidence, in hundredths.
WEIGHT = {"A": 60, "N": 70, "R": 85}
OTHER_WEIGHT = 50
WEIGHT_SQL = "CASE l_returnflag WHEN 'A' THEN 60 WHEN 'N' THEN 70 WHEN 'R' THEN 85 ELSE 50 END"


def sums() -> tuple[Column, ...]:
    return F.count("*").alias("n"), F.round(F.sum("quantity"), 3).alias("total_quantity"), F.round(F.sum(F.expr(VOLUME)), 1).alias("total_volume")


def material_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.concat_ws(", ", F.array_sort(F.collect_set("component_type"))).alias("types")
    return components(spark, sf_dir).groupBy("material").agg(*sums(), kinds)


def summary_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a type and the grand total 总计."""
    label = F.when(F.grouping("component_type") == 1, "总计").otherwise(F.col("component_type")).alias("label")
    return components(spark, sf_dir).rollup("component_type").agg(label, *sums()).drop("component_type")


def component_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by type, by material and in total, in one pass."""
    return components(spark, sf_dir).groupingSets([["component_type"], ["material"], []], "component_type", "material").agg(*sums())


def compliance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of components within the limits: quantity over 0, length 45 and width 4 at most."""
    ok = (F.col("quantity") > 0) & (F.col("length") <= 45) & (F.col("width") <= 4)
    return components(spark, sf_dir).groupBy("component_type").agg(F.count("*").alias("n"), F.count_if(ok).alias("compliant"), F.round(F.avg(ok.cast("double")), 6).alias("compliance_rate"))


def area_volume_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area by the type's rule (walls length x height, others length x width) and volume."""
    area = F.when(F.col("component_type") == "wall", F.col("length") * F.col("height")).otherwise(F.col("length") * F.col("width"))
    return components(spark, sf_dir).groupBy("component_type").agg(F.round(F.sum(area), 1).alias("area"), F.round(F.sum(F.expr(VOLUME)), 1).alias("volume"))


def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each drawing the component of most volume; ties go to the least ord, then material."""
    best = F.max_by(F.struct("ord", "component_type", "material"), F.struct(F.expr(VOLUME), -F.col("ord"), F.col("material"))).alias("best")
    return components(spark, sf_dir).groupBy("drawing_id").agg(best).select("drawing_id", "best.ord", "best.material")


def weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each drawing: sum(w c c) / sum(w c), with bonuses for agreement (0.1 at most) and several sources (0.05); 1 at most.

    Sums are of whole hundredths, so the result doesn't depend on the order of rows.
    """
    w = F.lit(OTHER_WEIGHT)
    for flag, value in WEIGHT.items():
        w = F.when(F.col("l_returnflag") == flag, value).otherwise(w)
    c = 100 - F.round(F.col("l_discount") * 100).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("drawing_id"), "l_returnflag", c.alias("c"), w.cast("long").alias("w"))
    mean = F.try_divide(F.sum(F.expr("w * c * c")).cast("double"), F.sum(F.expr("w * c")) * 100)
    n = F.count("c")
    variance = (n * F.sum(F.expr("c * c")) - F.sum("c") * F.sum("c")).cast("double") / (n * n * 10000)
    bonus = 0.1 * F.greatest(F.lit(0.0), 1 - variance) + F.when(F.min("l_returnflag") < F.max("l_returnflag"), 0.05).otherwise(0.0)
    return rows.groupBy("drawing_id").agg(F.round(F.least(F.lit(1.0), mean * 0.8 + bonus), 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (material_rollup, summary_with_total, component_statistics, compliance_report, area_volume_by_type, largest_component, weighted_confidence)}
ORACLES = {
    "material_rollup": f"WITH {COMPONENTS_SQL} SELECT material, {SUMS_SQL}, string_agg(DISTINCT component_type, ', ' ORDER BY component_type) AS types FROM components GROUP BY material",
    "summary_with_total": f"WITH {COMPONENTS_SQL} SELECT CASE WHEN grouping(component_type) = 1 THEN '总计' ELSE component_type END AS label, {SUMS_SQL} FROM components GROUP BY ROLLUP (component_type)",
    "component_statistics": f"WITH {COMPONENTS_SQL} SELECT component_type, material, {SUMS_SQL} FROM components GROUP BY GROUPING SETS ((component_type), (material), ())",
    "compliance_report": f"WITH {COMPONENTS_SQL} SELECT component_type, count(*) AS n, count(*) FILTER (ok) AS compliant, round(avg(ok::INT), 6) AS compliance_rate FROM (SELECT *, quantity > 0 AND length <= 45 AND width <= 4 AS ok FROM components) GROUP BY 1",
    "area_volume_by_type": f"WITH {COMPONENTS_SQL} SELECT component_type, round(sum(CASE component_type WHEN 'wall' THEN length * height ELSE length * width END), 1) AS area, round(sum(length * width * height), 1) AS volume FROM components GROUP BY 1",
    "largest_component": f"WITH {COMPONENTS_SQL} SELECT drawing_id, ord, material FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY length * width * height DESC, ord, material DESC) AS r FROM components) WHERE r = 1",
    "weighted_confidence": f"""SELECT drawing_id, round(least(1.0, wcc / (wc * 100) * 0.8::DOUBLE + (0.1::DOUBLE * greatest(0.0, 1 - v) + CASE WHEN many THEN 0.05 ELSE 0 END::DOUBLE)), 6) AS confidence
      FROM (SELECT drawing_id, sum(w * c * c)::DOUBLE AS wcc, sum(w * c)::DOUBLE AS wc, min(flag) < max(flag) AS many, (count(*) * sum(c * c) - sum(c) * sum(c))::DOUBLE / (count(*) * count(*) * 10000) AS v
        FROM (SELECT l_orderkey AS drawing_id, l_returnflag AS flag, 100 - round(l_discount * 100)::BIGINT AS c, {WEIGHT_SQL} AS w FROM lineitem) GROUP BY 1)""",
}
