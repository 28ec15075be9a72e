"""Look-ups by place: texts of a sheet's area from a table in the curve's order, and texts of many areas at once."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteflow.operators.greedy import shared_folder
from graniteflow.operators.places import in_box, points_in_boxes, write_in_order
from graniteflow.plans.tiling import REGIONS_SQL, regions
from graniteflow.session import table

#: Texts of an area that a reader lists.
LISTED = 100


def texts_in_area(spark: SparkSession, sf_dir: str, area: tuple[int, int, int, int] = (300, 200, 900, 700)) -> DataFrame:
    """Texts that begin in one area of any sheet, read back from a table in the curve's order."""
    folder = f"{shared_folder(spark)}/in-order-{uuid4().hex}"
    write_in_order(regions(spark, sf_dir).select("id", "sheet", "text", F.col("x1").alias("x"), F.col("y1").alias("y")), folder)
    return in_box(spark.read.parquet(folder), area).select("id", "sheet", "text", "x", "y")


def texts_of_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in each supplier's area of a sheet, numbered by id, and whether a reader lists them: the first LISTED are."""
    key = F.col("s_suppkey")
    x, y = key * 97 % 1700, key * 61 % 1700
    areas = table(spark, sf_dir, "supplier").select(
        key.alias("area"), (key % 7).alias("grp"), x.alias("x1"), y.alias("y1"), (x + 20 + key % 13 * 60).alias("x2"), (y + 20 + key % 11 * 70).alias("y2"),
    )
    points = regions(spark, sf_dir).select("grp", "id", "text", F.col("x1").alias("x"), F.col("y1").alias("y"))
    number = F.row_number().over(Window.partitionBy("area_").orderBy("id"))
    return points_in_boxes(points, areas).select(F.col("area_").alias("area"), "id", "text", number.alias("number")).withColumn("listed", F.col("number") <= LISTED)


QUERIES = {f.__name__: f for f in (texts_in_area, texts_of_areas)}
ORACLES = {
    "texts_in_area": f"WITH {REGIONS_SQL} SELECT id, sheet, text, x1 AS x, y1 AS y FROM r WHERE x1 BETWEEN 300 AND 900 AND y1 BETWEEN 200 AND 700",
    "texts_of_areas": f"""WITH {REGIONS_SQL}, p AS (SELECT s_suppkey AS area, s_suppkey % 7 AS grp, s_suppkey * 97 % 1700 AS x, s_suppkey * 61 % 1700 AS y, s_suppkey AS k FROM supplier),
      f AS (SELECT area, id, text, row_number() OVER (PARTITION BY area ORDER BY id)::INT AS number FROM p JOIN r ON p.grp = r.grp AND r.x1 BETWEEN x AND x + 20 + k % 13 * 60 AND r.y1 BETWEEN y AND y + 20 + k % 11 * 70)
      SELECT *, number <= {LISTED} AS listed FROM f""",
}
