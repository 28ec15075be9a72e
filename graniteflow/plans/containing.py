"""Where a component's code stands in the texts of tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.operators.containment import contained
from graniteflow.plans.tiling import REGIONS_SQL, regions


def inferred_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component of unknown tile with the first tile of its sheet, by row, column and text's id, a text of which holds its code, and how many texts do."""
    rows = regions(spark, sf_dir)
    lost = rows.where("id % 4 = 0").select("grp", "id", F.when(F.col("id") % 12 == 0, F.substring("text", 1, 2)).otherwise(F.col("text")).alias("part"))
    seen = rows.where("id % 4 != 0").select("grp", F.floor(F.col("y1") / 500).cast("int").alias("row"), F.floor(F.col("x1") / 500).cast("int").alias("col"), F.col("id").alias("at"), F.concat(F.lit("no. "), "text", F.lit("/"), F.col("size").cast("string")).alias("whole"))
    # of texts that are equal on a sheet the first tile's is enough; the rest are counted
    places = seen.groupBy("grp", "whole").agg(F.min(F.struct("row", "col", "at")).alias("first"), F.count("*").alias("texts"))
    found = contained(lost, seen, ("grp",)).join(places.hint("merge"), ["grp", "whole"]).groupBy("grp", "part").agg(F.min("first").alias("first"), F.sum("texts").alias("texts"))
    return lost.join(found.hint("merge"), ["grp", "part"], "left").select("id", F.col("part").alias("code"), "first.row", "first.col", F.coalesce("texts", F.lit(0)).alias("texts"))


QUERIES = {"inferred_tiles": inferred_tiles}
ORACLES = {
    "inferred_tiles": f"""WITH {REGIONS_SQL}, a AS (SELECT grp, id, CASE WHEN id % 12 = 0 THEN left(text, 2) ELSE text END AS code FROM r WHERE id % 4 = 0), b AS (SELECT grp, y1 // 500 AS row, x1 // 500 AS col, id AS nth, 'no. ' || text || '/' || size AS whole FROM r WHERE id % 4 != 0),
      m AS (SELECT a.id, code, row, col, nth FROM a LEFT JOIN b ON a.grp = b.grp AND contains(whole, code))
      SELECT id, code, arg_min(row, (row, col, nth))::INT AS row, arg_min(col, (row, col, nth))::INT AS col, count(nth) AS texts FROM m GROUP BY id, code"""
}
