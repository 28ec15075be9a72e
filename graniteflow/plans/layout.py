"""Boxes on a sheet: tiles, distances, reading order, lines, columns and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteflow.functions.geometry import cells, centre, clamped, squared_distance
from graniteflow.session import table

#: Side of the sheet, step and side of its square tiles, cell of the search grid, reach of a text, in pixels.
SHEET, STEP, TILE, CELL, REACH = 2000, 400, 500, 200, 150
SIDE = SHEET // STEP
#: Offsets are known for tiles below this number. So many boxes and texts lie on a sheet, so pairs and windows grow with the sheets.
KNOWN = 20
SHEET_BOXES, SHEET_TEXTS = 2000, 100


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_partkey") * 37 % SHEET, F.col("p_partkey") * 53 % SHEET
    size = F.col("p_size")
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / SHEET_BOXES).alias("sheet"), F.col("p_brand").alias("grp"), F.col("p_type").alias("kind"), F.col("p_name").alias("text"), x.alias("x1"), y.alias("y1"), (x + 10 + size).alias("x2"), (y + 10 + size % 20).alias("y2"))


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).withColumns({"cx": centre("x1", "x2"), "cy": centre("y1", "y2")})


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("text_id"), F.floor(key / SHEET_TEXTS).alias("sheet"), (key * 71 % SHEET).alias("tx"), (key * 29 % SHEET).alias("ty"))


def tiles(spark: SparkSession, most: int) -> DataFrame:
    """A row for each tile, in reading order; their number is fixed by the sheet."""
    n = F.col("id").cast("int")
    return spark.range(most).select(n.alias("tile"), (n % SIDE * STEP).alias("ox"), (F.floor(n / SIDE) * STEP).alias("oy"))


def tile_offset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes moved by their tile's offset, kept on the sheet; an unknown tile moves nothing."""
    tile = F.pmod("id", F.lit(SIDE * SIDE)).cast("int")
    moved = boxes(spark, sf_dir).withColumn("tile", tile).join(F.broadcast(tiles(spark, KNOWN)), "tile", "left")
    to = {k: clamped(F.col(k) + F.coalesce(F.col(o), F.lit(0)), SHEET).alias(f"g{k}") for k, o in (("x1", "ox"), ("y1", "oy"), ("x2", "ox"), ("y2", "oy"))}
    return moved.select("id", "tile", *to.values())


def point_in_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tile, in reading order, that holds a box's centre; joined on cells of the search grid."""
    wide = tiles(spark, SIDE * SIDE).withColumn("gx", F.explode(cells(F.col("ox"), F.col("ox") + TILE, CELL)))
    wide = wide.withColumn("gy", F.explode(cells(F.col("oy"), F.col("oy") + TILE, CELL)))
    at = centres(spark, sf_dir).select("id", "cx", "cy", F.floor(F.col("cx") / CELL).alias("gx"), F.floor(F.col("cy") / CELL).alias("gy"))
    inside = F.col("cx").between(F.col("ox"), F.col("ox") + TILE) & F.col("cy").between(F.col("oy"), F.col("oy") + TILE)
    return at.join(F.broadcast(wide), ["gx", "gy"], "left").groupBy("id").agg(F.min(F.when(inside, F.col("tile"))).alias("tile"))


def near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a box and a text of its sheet within REACH: texts lie in cells, boxes ask the cells about them."""
    asks = centres(spark, sf_dir).withColumn("gx", F.explode(cells(F.col("cx") - REACH, F.col("cx") + REACH, CELL)))
    asks = asks.withColumn("gy", F.explode(cells(F.col("cy") - REACH, F.col("cy") + REACH, CELL)))
    at = texts(spark, sf_dir).withColumns({"gx": F.floor(F.col("tx") / CELL), "gy": F.floor(F.col("ty") / CELL)})
    return asks.join(at, ["sheet", "gx", "gy"]).withColumn("d2", squared_distance("cx", "cy", "tx", "ty")).where(F.col("d2") <= REACH * REACH)


def radius_text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each box with texts near it: how many, and the nearest."""
    return near_texts(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"), F.min_by("text_id", F.struct("d2", "text_id")).alias("nearest"))


def nearest_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest texts of each box: a top-k for each key."""
    order = Window.partitionBy("id").orderBy("d2", "text_id")
    return near_texts(spark, sf_dir).select("id", "text_id", F.row_number().over(order).alias("rank")).where("rank <= 3")


def first_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least id of each kind in each cell of 100 pixels."""
    cell = [F.floor(F.col(c) / 100).alias(n) for c, n in (("x1", "gx"), ("y1", "gy"))]
    return boxes(spark, sf_dir).groupBy("kind", *cell).agg(F.min("id").alias("id"), F.count("*").alias("n"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with one text and group: the first stays, with the number of those it stands for."""
    return boxes(spark, sf_dir).groupBy("text", "grp").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("sheet", "grp").orderBy("weight", "id")
    weighed = centres(spark, sf_dir).withColumn("weight", F.col("cy") / SHEET * 1000 + F.col("cx") / SHEET)
    return weighed.select("sheet", "grp", "id", (F.row_number().over(order) - 1).alias("place"))


def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sheet's group, how often the next box by id lies over 10 pixels higher."""
    order = Window.partitionBy("sheet", "grp").orderBy("id")
    rows = centres(spark, sf_dir).select("sheet", "grp", (F.lead("cy").over(order) < F.col("cy") - 10).alias("bad"))
    return rows.groupBy("sheet", "grp").agg(F.count_if("bad").alias("violations"))


def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a sheet's group: a box begins one when its centre is over 10 pixels below the box before it."""
    order = Window.partitionBy("sheet", "grp").orderBy("cy", "id")
    flagged = centres(spark, sf_dir).withColumn("new", (F.coalesce(F.col("cy") - F.lag("cy").over(order), F.lit(99)) > 10).cast("int"))
    return flagged.select("sheet", "grp", "id", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("line"))


def column_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds between the columns of a sheet's group: the middle of gaps over 50 pixels of its sorted distinct centres."""
    order = Window.partitionBy("sheet", "grp").orderBy("cx")
    rows = centres(spark, sf_dir).select("sheet", "grp", "cx").distinct().withColumn("before", F.lag("cx").over(order))
    return rows.where(F.col("cx") - F.col("before") > 50).select("sheet", "grp", ((F.col("cx") + F.col("before")) / 2).alias("bound"))


def group_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hull of a group's boxes and the spread of their centres, 1 at most."""
    hull = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    spread = F.round(F.least(F.lit(1.0), (F.var_pop("cx") + F.var_pop("cy")) / 1_000_000), 6).alias("spread")
    return centres(spark, sf_dir).groupBy("grp").agg(*hull, spread)


QUERIES = {f.__name__: f for f in (tile_offset_join, point_in_tile, radius_text_join, nearest_three, first_per_cell, exact_duplicates, reading_order, order_violations, line_islands, column_gaps, group_spread)}
_B = """b AS (SELECT p_partkey AS id, p_partkey // 2000 AS sheet, p_brand AS grp, p_type AS kind, p_name AS text, p_partkey * 37 % 2000 AS x1, p_partkey * 53 % 2000 AS y1,
  p_partkey * 37 % 2000 + 10 + p_size AS x2, p_partkey * 53 % 2000 + 10 + p_size % 20 AS y2 FROM part), c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM b)"""
_T = "t AS (SELECT n::INT AS tile, n % 5 * 400 AS ox, n // 5 * 400 AS oy FROM range(25) r(n))"
_P = _B + ", p AS (SELECT c.id, s_suppkey AS text_id, (cx - s_suppkey * 71 % 2000) ** 2 + (cy - s_suppkey * 29 % 2000) ** 2 AS d2 FROM c JOIN supplier ON s_suppkey // 100 = sheet WHERE d2 <= 22500)"
_G = {k: f"round(greatest(0.0, least(({k} + CASE WHEN id % 25 < 20 THEN {o} ELSE 0 END)::DOUBLE, 2000.0)), 2) AS g{k}" for k, o in (("x1", "ox"), ("y1", "oy"), ("x2", "ox"), ("y2", "oy"))}
ORACLES = {
    "tile_offset_join": f"WITH {_B}, {_T} SELECT id, tile, {', '.join(_G.values())} FROM b JOIN t ON id % 25 = tile",
    "point_in_tile": f"WITH {_B}, {_T} SELECT id, min(tile) AS tile FROM c LEFT JOIN t ON cx BETWEEN ox AND ox + 500 AND cy BETWEEN oy AND oy + 500 GROUP BY id",
    "radius_text_join": f"WITH {_P} SELECT id, count(*) AS n, arg_min(text_id, (d2, text_id)) AS nearest FROM p GROUP BY id",
    "nearest_three": f"WITH {_P} SELECT * FROM (SELECT id, text_id, row_number() OVER (PARTITION BY id ORDER BY d2, text_id)::INT AS rank FROM p) WHERE rank <= 3",
    "first_per_cell": f"WITH {_B} SELECT kind, x1 // 100 AS gx, y1 // 100 AS gy, min(id) AS id, count(*) AS n FROM b GROUP BY ALL",
    "exact_duplicates": f"WITH {_B} SELECT text, grp, min(id) AS id, count(*) AS n FROM b GROUP BY ALL",
    "reading_order": f"WITH {_B} SELECT sheet, grp, id, (row_number() OVER (PARTITION BY sheet, grp ORDER BY cy / 2000 * 1000 + cx / 2000, id) - 1)::INT AS place FROM c",
    "order_violations": f"WITH {_B} SELECT sheet, grp, count(*) FILTER (nxt < cy - 10) AS violations FROM (SELECT *, lead(cy) OVER (PARTITION BY sheet, grp ORDER BY id) AS nxt FROM c) GROUP BY ALL",
    "line_islands": f"WITH {_B}, f AS (SELECT *, (coalesce(cy - lag(cy) OVER (PARTITION BY sheet, grp ORDER BY cy, id), 99) > 10)::INT AS new FROM c) SELECT sheet, grp, id, sum(new) OVER (PARTITION BY sheet, grp ORDER BY cy, id ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM f",
    "column_gaps": f"WITH {_B}, d AS (SELECT DISTINCT sheet, grp, cx FROM c), l AS (SELECT *, lag(cx) OVER (PARTITION BY sheet, grp ORDER BY cx) AS was FROM d) SELECT sheet, grp, (cx + was) / 2 AS bound FROM l WHERE cx - was > 50",
    "group_spread": f"WITH {_B} SELECT grp, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(least(1.0, (var_pop(cx) + var_pop(cy)) / 1000000), 6) AS spread FROM c GROUP BY grp",
}
