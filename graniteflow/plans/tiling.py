"""Sheets and their tiles: plans, grids, estimates, checks, and measures of boxes against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.functions import geometry as g
from graniteflow.operators.greedy import meeting
from graniteflow.session import spread, table

EXTENSIONS = ["pdf", "dwg", "tif", "png"]


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a sheet with a width, height, file size, density and extension."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", (key * 37 % 9000 + 300).cast("int").alias("w"), (key * 53 % 9000 + 300).cast("int").alias("h"), (key * 7919 % 70_000_000).alias("bytes"), (key % 40 / 100).alias("density"),
        F.get(F.array(*map(F.lit, EXTENSIONS)), (key % 4).cast("int")).alias("ext"),
    )


def slicing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sheet's grid and tile size, and the quick estimate of its tiles."""
    w, h = F.col("w"), F.col("h")
    return sheets(spark, sf_dir).select("p_partkey", g.slicing_plan(w, h).alias("_p"), g.estimated_tiles(w, h).alias("estimate")).select("p_partkey", "_p.*", "estimate")


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each tile of each sheet, with its place, size and shared bands."""
    return sheets(spark, sf_dir).select("p_partkey", F.inline(g.tiles_of(F.col("w"), F.col("h"))))


def adaptive_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sheet's strategy and how many tiles it gives, by priority of its density."""
    w, h, d = F.col("w"), F.col("h"), F.col("density")
    return sheets(spark, sf_dir).select("p_partkey", g.adaptive_size(w, h, d).alias("_s"), g.adaptive_count(w, h, d).alias("_t"), g.priority(d).alias("priority")).select("p_partkey", "_s.*", "_t.*", "priority")


def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sheets by priority, then number."""
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return sheets(spark, sf_dir).select("p_partkey", g.priority(F.col("density")).alias("priority")).orderBy(rank, "p_partkey")


def sheet_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each sheet needs slicing, whether it is sliced, how complex it is, and by what it is resized."""
    w, h, key = F.col("w"), F.col("h"), F.col("p_partkey")
    force = F.when(key % 10 == 0, True).when(key % 10 == 1, False)
    return sheets(spark, sf_dir).select(
        "p_partkey", F.array_join(g.needs_slicing(w, h, F.col("bytes")), ",").alias("reasons"), g.use_slicing(force, key % 3 != 0, w, h).alias("sliced"),
        g.complexity(F.col("bytes"), w, h, F.col("ext")).alias("complexity"), F.round(g.scale((key % 5 * 10).cast("double"), w, h), 6).alias("scale"),
    )


def tile_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row and column of a tile at a point of each sheet; sheets by elevens have no size."""
    key = F.col("p_partkey")
    w = F.when(key % 11 == 0, 0).otherwise(F.col("w"))
    place = g.tile_place((key % 9).cast("int"), F.lit(9), w, F.col("h"), F.col("w") * 2 / 3, F.col("h") / 2)
    return sheets(spark, sf_dir).select("p_partkey", place.alias("_p")).select("p_partkey", "_p.*", g.adjacent(F.col("_p.row"), F.col("_p.col"), F.lit(1), F.lit(1)).alias("adjacent"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in threes that overlap, 300 a sheet, with a text and a confidence in thousandths."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("int")
    group, step = F.floor(key / 3), key % 3
    x, y = (group * 37 % 1900 + step * 4).cast("int"), (group * 53 % 1900 + step * 2).cast("int")
    code = F.concat(F.get(F.array(*map(F.lit, ["KZ", "L", "B", "Q", "KL"])), (group % 5).cast("int")), (group % 50).cast("string"), F.when(key % 9 == 0, "A").otherwise(""))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type"), "p_partkey").select(
        F.col("p_partkey").alias("id"), F.floor(key / 300).cast("long").alias("grp"), F.floor(key / 300).cast("long").alias("sheet"), x.alias("x1"), y.alias("y1"), (x + 40 + size % 20).alias("x2"), (y + 20 + size % 5).alias("y2"),
        code.alias("text"), (key * 7919 % 1000).cast("int").alias("conf"), F.element_at(F.split("p_type", " "), 1).alias("kind"), F.col("p_type").alias("material"), size.alias("size"),
    )


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a sheet's boxes that overlap, by each measure."""
    boxes = regions(spark, sf_dir).select("grp", "id", *g.BOX)
    measures = {"iou": F.round(g.iou(), 6), "overlaps": g.overlaps(), "size_likeness": F.round(g.size_likeness(), 6), "spatial": F.round(g.spatial_likeness(), 6)}
    return meeting(boxes, g.shared_area() > 0, give=measures)


def edge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each box lies at the edge of its tile of 500 pixels and in the bands that tiles share."""
    local = regions(spark, sf_dir).select("id", *[(F.col(c) % 500).alias(c) if c in ("x1", "y1") else c for c in ("x1", "y1")], (F.col("x1") % 500 + F.col("x2") - F.col("x1")).alias("x2"), (F.col("y1") % 500 + F.col("y2") - F.col("y1")).alias("y2"))
    kind = F.when(F.col("id") % 2 == 0, "component_id").otherwise("unknown")
    band = F.when(F.col("id") % 3 == 0, 100).otherwise(0)
    return local.select("id", g.near_edge(F.when(F.col("id") % 13 == 0, 0).otherwise(500), F.lit(500), kind).alias("edge"), g.in_shared_band(band, band, band, band, 500).alias("band"))


def moved_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box as a polygon, moved by its sheet's offset, and the box around it again; boxes in cells of 100 pixels."""
    shape = g.moved(g.corners(*[F.col(c) for c in g.BOX]), F.col("sheet") * 1000.0, F.lit(-5.0))
    rows = regions(spark, sf_dir).select("id", g.hull(shape).alias("_b"), F.size(shape).alias("corners"), g.cell(F.col("x1")).alias("cx"), F.floor(F.col("y1") / 2000 * 10).alias("gy"))
    return rows.select("id", "_b.*", "corners", "cx", "gy")


def discrepancy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between each box and the second one of its three: text, place."""
    rows = regions(spark, sf_dir).select("id", "text", "x1", "y1", F.floor(F.col("id") / 3).alias("three"))
    second = rows.where("id % 3 = 1").select("three", F.col("text").alias("label"), F.col("x1").alias("bx"), F.col("y1").alias("by"))
    both = rows.join(second, "three")
    found = g.discrepancies(F.col("text"), F.col("label"), (F.col("x1") - F.col("bx")) * 6, F.col("y1") - F.col("by"))
    return both.select("id", F.array_join(found, ",").alias("differs"), F.when(F.size(found) == 0, "consistent").otherwise("inconsistent").alias("status"))


QUERIES = {
    f.__name__: f for f in (slicing_plan, tile_grid, adaptive_strategy, priority_order, sheet_checks, tile_places, iou_pairs, edge_flags, moved_polygons, discrepancy_rows)
}

_S = f"""s AS (SELECT p_partkey, (p_partkey * 37 % 9000 + 300)::INT AS w, (p_partkey * 53 % 9000 + 300)::INT AS h, p_partkey * 7919 % 70000000 AS bytes, p_partkey % 40 / 100 AS density, {EXTENSIONS}[p_partkey % 4 + 1] AS ext FROM part)"""
_P = f"""{_S}, n AS (SELECT *, ceil(w / 1844)::INT AS ax, ceil(h / 1844)::INT AS ay, w > 2048 OR h > 2048 AS sliced FROM s),
  p AS (SELECT *, CASE WHEN sliced THEN ax ELSE 1 END AS nx, CASE WHEN sliced THEN ay ELSE 1 END AS ny, CASE WHEN sliced THEN least(2048, (w + 204 * (ax - 1)) // ax) ELSE w END::INT AS tw, CASE WHEN sliced THEN least(2048, (h + 204 * (ay - 1)) // ay) ELSE h END::INT AS th FROM n)"""
_A = f"""{_S}, a AS (SELECT *, CASE WHEN w::BIGINT * h < 2048 * 2048 THEN 'fine_grain' WHEN w::BIGINT * h > 8192 * 8192 THEN 'coarse_grain' ELSE 'balanced' END AS kind,
    CASE WHEN w::BIGINT * h < 2048 * 2048 THEN 512 WHEN w::BIGINT * h > 8192 * 8192 THEN 2048 WHEN density > 0.15 THEN 768 ELSE 1024 END AS size FROM s),
  b AS (SELECT *, size // 8 AS overlap, greatest(1, (w - size // 8) // (size - size // 8)) AS nx, greatest(1, (h - size // 8) // (size - size // 8)) AS ny FROM a),
  t AS (SELECT p_partkey, least(size, w - c * (size - overlap)) AS tw, least(size, h - r * (size - overlap)) AS th, size FROM b, unnest(range(ny)) AS rr(r), unnest(range(nx)) AS cc(c)),
  k AS (SELECT p_partkey, count(*) AS n, sum(tw::BIGINT * th) AS pixels FROM t WHERE tw >= size // 2 AND th >= size // 2 GROUP BY 1)"""
_PRIORITY = "CASE WHEN density > 0.1 THEN 'high' WHEN density > 0.05 THEN 'medium' ELSE 'low' END"
REGIONS_SQL = """r AS (SELECT p_partkey AS id, p_partkey // 300 AS grp, p_partkey // 300 AS sheet, (p_partkey // 3 * 37 % 1900 + p_partkey % 3 * 4)::INT AS x1, (p_partkey // 3 * 53 % 1900 + p_partkey % 3 * 2)::INT AS y1,
    (p_partkey // 3 * 37 % 1900 + p_partkey % 3 * 4 + 40 + p_size % 20)::INT AS x2, (p_partkey // 3 * 53 % 1900 + p_partkey % 3 * 2 + 20 + p_size % 5)::INT AS y2,
    ['KZ', 'L', 'B', 'Q', 'KL'][p_partkey // 3 % 5 + 1] || p_partkey // 3 % 50 || CASE WHEN p_partkey % 9 = 0 THEN 'A' ELSE '' END AS text, (p_partkey * 7919 % 1000)::INT AS conf, split_part(p_type, ' ', 1) AS kind, p_type AS material, p_size::INT AS size FROM part)"""
PAIRS_SQL = f"""{REGIONS_SQL}, q AS (SELECT a.grp AS grp, a.id AS low, b.id AS high, a.text AS text, b.text AS text_, a.conf AS conf, b.conf AS conf_, a.kind AS kind, b.kind AS kind_,
    greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS shared, (a.x2 - a.x1) * (a.y2 - a.y1) AS area, (b.x2 - b.x1) * (b.y2 - b.y1) AS area_,
    a.x2 - a.x1 AS w, b.x2 - b.x1 AS w_, a.y2 - a.y1 AS h, b.y2 - b.y1 AS h_, a.x1 AS x1, b.x1 AS x1_, a.y1 AS y1, b.y1 AS y1_,
    sqrt(((a.x1 + a.x2 - b.x1 - b.x2) / 2) ** 2 + ((a.y1 + a.y2 - b.y1 - b.y2) / 2) ** 2) AS d FROM r a JOIN r b ON a.grp = b.grp AND a.id < b.id),
  pairs AS (SELECT *, shared / (area + area_ - shared) AS iou FROM q)"""
ORACLES = {
    "slicing_plan": f"""WITH {_P} SELECT p_partkey, nx, ny, tw AS tile_width, th AS tile_height, sliced,
      CASE WHEN greatest(w, h) <= 2048 THEN 1 ELSE greatest(1, ceil(w / (2048 * 0.9::DOUBLE))) * greatest(1, ceil(h / (2048 * 0.9::DOUBLE))) END::INT AS estimate FROM p""",
    "tile_grid": f"""WITH {_P} SELECT p_partkey, r::INT AS row, c::INT AS col, least(c * (tw - 204), greatest(0, w - tw))::INT AS x, least(r * (th - 204), greatest(0, h - th))::INT AS y, tw AS width, th AS height,
      CASE WHEN c > 0 THEN 204 ELSE 0 END AS left, CASE WHEN r > 0 THEN 204 ELSE 0 END AS top, CASE WHEN c < nx - 1 THEN 204 ELSE 0 END AS right, CASE WHEN r < ny - 1 THEN 204 ELSE 0 END AS bottom
      FROM p, unnest(range(ny)) AS rr(r), unnest(range(nx)) AS cc(c)""",
    "adaptive_strategy": f"WITH {_A} SELECT b.p_partkey, kind, size, overlap, coalesce(n, 0)::INT AS n, coalesce(pixels, 0)::BIGINT AS pixels, {_PRIORITY} AS priority FROM b LEFT JOIN k USING (p_partkey)",
    "priority_order": f"WITH {_S} SELECT p_partkey, {_PRIORITY} AS priority FROM s ORDER BY CASE {_PRIORITY} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, p_partkey",
    "sheet_checks": f"""WITH {_S} SELECT p_partkey, concat_ws(',', CASE WHEN w > 2048 THEN 'width' END, CASE WHEN h > 2048 THEN 'height' END, CASE WHEN bytes > 1572864 THEN 'size' END) AS reasons,
      CASE p_partkey % 10 WHEN 0 THEN true WHEN 1 THEN false ELSE p_partkey % 3 != 0 AND greatest(w, h) > 2048 END AS sliced,
      least(10.0, CASE WHEN w::BIGINT * h > 50000000 THEN 4 WHEN w::BIGINT * h > 20000000 THEN 3 WHEN w::BIGINT * h > 8000000 THEN 2 WHEN w::BIGINT * h > 2000000 THEN 1 ELSE 0 END
        + CASE WHEN bytes / 1048576 > 50 THEN 3 WHEN bytes / 1048576 > 20 THEN 2 WHEN bytes / 1048576 > 5 THEN 1 ELSE 0 END + CASE ext WHEN 'dwg' THEN 2 WHEN 'pdf' THEN 1.5 WHEN 'tif' THEN 1 ELSE 0 END
        + CASE WHEN greatest(w / h, h / w) > 3 THEN 1 ELSE 0 END)::DOUBLE AS complexity,
      round(CASE WHEN p_partkey % 5 > 0 THEN greatest(0.5, least(3.0, 24.0 / (p_partkey % 5 * 10), 4096 / greatest(w, h))) WHEN greatest(w, h) > 4096 THEN 4096 / greatest(w, h)
        WHEN greatest(w, h) < 1024 THEN least(2.0, 1024 / greatest(w, h)) ELSE 1.0 END::DOUBLE, 6) AS scale FROM s""",
    "tile_places": f"""WITH {_S}, z AS (SELECT *, p_partkey % 11 != 0 AS sized, ceil(sqrt(9 * h / w)) AS rows FROM s), y AS (SELECT *, ceil(9 / rows) AS cols FROM z),
      x AS (SELECT p_partkey, CASE WHEN sized THEN least(floor(h / 2 / greatest(1, floor(h / rows))), rows - 1) ELSE p_partkey % 9 // 3 END::INT AS row,
        CASE WHEN sized THEN least(floor(w * 2 / 3 / greatest(1, floor(w / cols))), cols - 1) ELSE p_partkey % 9 % 3 END::INT AS col FROM y)
      SELECT p_partkey, row, col, abs(row - 1) <= 1 AND abs(col - 1) <= 1 AND (row != 1 OR col != 1) AS adjacent FROM x""",
    "iou_pairs": f"""WITH {PAIRS_SQL} SELECT low, high, round(iou, 6) AS iou, shared / area > 0.3 OR shared / area_ > 0.3 AS overlaps, round((least(w, w_) / greatest(w, w_) + least(h, h_) / greatest(h, h_)) / 2, 6) AS size_likeness,
      round(greatest(0.0, 1 - d / 50) * 0.6::DOUBLE + least(area, area_) / greatest(area, area_) * 0.4::DOUBLE, 6) AS spatial FROM pairs WHERE shared > 0""",
    "edge_flags": f"""WITH {REGIONS_SQL}, l AS (SELECT id, x1 % 500 AS a, y1 % 500 AS b, x1 % 500 + x2 - x1 AS c, y1 % 500 + y2 - y1 AS d, CASE WHEN id % 2 = 0 THEN 30 ELSE 20 END AS n, CASE WHEN id % 3 = 0 THEN 100 ELSE 0 END AS m FROM r)
      SELECT id, id % 13 != 0 AND (a <= n OR c >= 500 - n OR b <= n OR d >= 500 - n) AS edge, (a + c) / 2 < m OR (a + c) / 2 > 500 - m OR (b + d) / 2 < m OR (b + d) / 2 > 500 - m AS band FROM l""",
    "moved_polygons": f"""WITH {REGIONS_SQL} SELECT id, (x1 + sheet * 1000)::DOUBLE AS x1, (y1 - 5)::DOUBLE AS y1, (x2 + sheet * 1000)::DOUBLE AS x2, (y2 - 5)::DOUBLE AS y2, 4 AS corners, (x1 // 100 * 100)::BIGINT AS cx, floor(y1 / 2000 * 10)::BIGINT AS gy FROM r""",
    "discrepancy_rows": f"""WITH {REGIONS_SQL}, d AS (SELECT a.id, concat_ws(',', CASE WHEN a.text != b.text THEN 'text_mismatch' END, CASE WHEN abs(a.x1 - b.x1) * 6 > 20 OR abs(a.y1 - b.y1) > 20 THEN 'coordinate_mismatch' END) AS differs
      FROM r a JOIN r b ON b.id % 3 = 1 AND a.id // 3 = b.id // 3) SELECT id, differs, CASE WHEN differs = '' THEN 'consistent' ELSE 'inconsistent' END AS status FROM d""",
}
