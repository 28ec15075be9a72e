"""Quantity take-off queries over the example tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.session import table

#: First word of ``p_type`` to component type.
TYPE_OF_WORD = {
    "STANDARD": "wall",
    "SMALL": "column",
    "MEDIUM": "beam",
    "LARGE": "slab",
    "PROMO": "foundation",
}


def kind_of_part() -> Column:
    word, kind = F.split("p_type", " ")[0], F.lit("unknown")
    for key, value in TYPE_OF_WORD.items():
        kind = F.when(word == key, value).otherwise(kind)
    return kind


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component rows drawn from lineitem and part: one row a line item."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", kind_of_part().alias("component_type"), (F.col("p_size") / 10).alias("width"), F.col("p_brand").alias("material")
    )
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("drawing_id"), "l_partkey", F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("length"),
        F.col("l_linenumber").cast("double").alias("quantity"), (F.col("l_suppkey") % 16).alias("slice_index"),
    )
    return line.join(part, line.l_partkey == part.p_partkey).select(
        "drawing_id", "ord", "component_type", "length", "width", F.lit(3.0).alias("height"), "quantity", "material", "slice_index"
    )


def quantity_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and their quantity by type; line items are summed by part before the join."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("quantity"))
    part = table(spark, sf_dir, "part").select("p_partkey", kind_of_part().alias("component_type"))
    return lines.join(part, "p_partkey").groupBy("component_type").agg(F.sum("n").alias("n"), F.sum("quantity").cast("double").alias("total_quantity"))


COMPONENTS_SQL = """components AS (
  SELECT l_orderkey AS drawing_id, l_linenumber AS ord,
         CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 'wall' WHEN 'SMALL' THEN 'column' WHEN 'MEDIUM' THEN 'beam'
              WHEN 'LARGE' THEN 'slab' WHEN 'PROMO' THEN 'foundation' ELSE 'unknown' END AS component_type,
         l_quantity AS length, p_size / 10 AS width, 3.0::DOUBLE AS height, l_linenumber::DOUBLE AS quantity,
         p_brand AS material, l_suppkey % 16 AS slice_index
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

QUERIES = {"quantity_by_type": quantity_by_type}
ORACLES = {
    "quantity_by_type": f"WITH {COMPONENTS_SQL} SELECT component_type, count(*) AS n, round(sum(quantity), 3) AS total_quantity FROM components GROUP BY 1"
}
