"""Workbooks as rows: the sheet, the row's number on it and its cells. ``sources.files.export_sheets`` writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteflow.functions import quantities as q
from graniteflow.plans.quantities import _STD, once, standard
from graniteflow.plans.takeoff import COMPONENTS_SQL, components
from graniteflow.session import table

#: Types in the order of their sheets, with their name and their sheet's; the other sheets; headings.
TYPES = {"wall": ("墙体", "墙体工程量"), "column": ("柱子", "柱子工程量"), "beam": ("梁", "梁工程量"), "slab": ("板", "板工程量"), "foundation": ("基础", "基础工程量")}
TOTALS = "总工程量汇总"
DETAIL, SUMMARY = "工程量明细", "工程量汇总"
REPORT_SHEETS = ("汇总信息", "构件明细", "图纸清单")
TITLE = "智能工程量计算系统 - 总工程量汇总表"
ITEM_HEAD = ["序号", "构件名称", "长度(m)", "宽度(m)", "高度/厚度(m)", "数量", "体积(m³)", "面积(m²)"]
TOTAL_HEAD = ["构件类型", "数量(个)", "体积(m³)", "面积(m²)", "备注"]
DETAIL_HEAD = ["构件编号", "构件类型", "构件标签", "长度(m)", "宽度(m)", "高度(m)", "工程量", "单位", "标准合规", "备注"]
SUMMARY_HEAD = ["构件类型", "数量", "总工程量", "单位", "平均工程量"]
COMPONENT_HEAD = ["构件类型", "构件编号", "数量", "计算值", "单位"]
DRAWING_HEAD = ["序号", "图号", "图名", "构件数量", "状态"]
#: Cells are parted by this in a row's text.
PART = "|"


def cells(*values: Column | str) -> Column:
    """Cells as one text; null ones are empty."""
    return F.array_join(F.array(*[F.coalesce(v.cast("string"), F.lit("")) if isinstance(v, Column) else F.lit(v) for v in values]), PART)


def at(value: Column, decimals: int = 2) -> Column:
    """A number with so many decimals, halves up, of its first nine decimals: what sums differ by in their order doesn't show. Null for what is no number."""
    return F.round(value.try_cast("decimal(38,9)"), decimals).cast("string")


def line(place: Column | int, *values: Column | str) -> Column:
    """A row of a sheet, to be exploded with others."""
    return F.struct((place if isinstance(place, Column) else F.lit(place)).cast("long").alias("place"), cells(*values).alias("cells"))


def headings(sheets: dict[str, list[str]]) -> Column:
    """The first row of each sheet, to be exploded."""
    return F.array(*[F.struct(F.lit(s).alias("sheet"), F.lit(1).cast("long").alias("place"), cells(*h).alias("cells")) for s, h in sheets.items()])


def chosen(kind: Column, which: int) -> Column:
    """A type's name (0) or its sheet's (1)."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in TYPES.items() for x in (k, v[which])]), kind)


def quantity_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each drawing: the totals' sheet, then one for each type that it has, with numbered items and their sums.

    Components of other types, and those whose rule misses a dimension, aren't in it. The sheets' heads and sums come
    from one aggregate by drawing and type; items are numbered by a window over drawing and type.
    """
    kind, none = F.col("component_type"), F.lit(None).cast("double")
    dims = {"length": F.col("length"), "width": F.col("width"), "height": F.col("height"), "thickness": none, "diameter": none}
    rows = once(components(spark, sf_dir), q.take_off(kind, dims, F.lit(1.0)), "_q").where("_q IS NOT NULL").select("*", "_q.volume", "_q.area")
    order = Window.partitionBy("drawing_id", "component_type").orderBy("ord", "length", "width", "material", "quantity")
    number = F.row_number().over(order)
    item = cells(number, F.col("material"), at(F.col("length")), at(F.col("width")), at(F.col("height")), F.col("quantity").cast("long"), at(F.col("volume")), at(F.col("area")))
    items = rows.select("drawing_id", chosen(kind, 1).alias("sheet"), (number + 3).cast("long").alias("place"), item.alias("cells"))
    types = rows.groupBy("drawing_id", "component_type").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.sum("area").alias("area"))
    sheet = chosen(kind, 1)
    frame = F.array(
        line(1, F.concat(sheet, F.lit("明细表"))), line(3, *ITEM_HEAD), line(F.col("n") + 5, "汇总", "", "", "", "", F.col("n"), at(F.col("volume")), at(F.col("area"))),
    )
    frames = types.select("drawing_id", sheet.alias("sheet"), F.inline(frame))
    place = F.array_position(F.array(*map(F.lit, TYPES)), kind)
    ranked = F.row_number().over(Window.partitionBy("drawing_id").orderBy(place))  # five rows at most
    of_types = types.select("drawing_id", F.lit(TOTALS).alias("sheet"), (ranked + 10).cast("long").alias("place"), cells(chosen(kind, 0), F.col("n"), at(F.col("volume")), at(F.col("area")), "").alias("cells"))
    sums = types.groupBy("drawing_id").agg(F.sum("n").alias("n"), F.sum("volume").alias("volume"), F.sum("area").alias("area"))
    head = F.array(
        line(1, TITLE), line(3, "图纸名称", F.col("drawing_id")), line(4, "计算时间", ""), line(5, "构件总数", F.col("n")),
        line(6, "总体积(m³)", at(F.col("volume"))), line(7, "总面积(m²)", at(F.col("area"))), line(10, *TOTAL_HEAD),
    )
    totals = sums.select("drawing_id", F.lit(TOTALS).alias("sheet"), F.inline(head))
    return totals.unionByName(of_types).unionByName(frames).unionByName(items)


def detail_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each drawing by the standard rules: every component with unit, compliance and notes, and sums by type."""
    rows, kind = standard(spark, sf_dir), F.col("component_type")
    order = Window.partitionBy("drawing_id").orderBy("ord", "component_type", "material", "length", "width", "height")
    item = cells(
        F.concat_ws("-", "drawing_id", "ord"), kind, F.col("material"), at(F.col("length")), at(F.col("width")), at(F.col("height")), at(F.col("quantity"), 3), F.col("unit"),
        F.when(F.col("compliant"), "是").otherwise("否"), F.array_join("notes", "; "),
    )
    items = rows.select("drawing_id", F.lit(DETAIL).alias("sheet"), (F.row_number().over(order) + 1).cast("long").alias("place"), item.alias("cells"))
    types = rows.groupBy("drawing_id", "component_type", "unit").agg(F.count("*").alias("n"), F.sum("quantity").alias("total"))
    ranked = F.row_number().over(Window.partitionBy("drawing_id").orderBy("component_type"))  # as many rows as types
    sums = types.select("drawing_id", F.lit(SUMMARY).alias("sheet"), (ranked + 1).cast("long").alias("place"), cells(kind, F.col("n"), at(F.col("total"), 3), F.col("unit"), at(F.col("total") / F.col("n"), 1)).alias("cells"))
    heads = types.select("drawing_id").distinct().select("drawing_id", F.inline(headings({DETAIL: DETAIL_HEAD, SUMMARY: SUMMARY_HEAD})))
    return heads.unionByName(sums).unionByName(items)


def report_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sheets of each owner's report: totals, components by type, and drawings with how many components they have, ones without any too."""
    info, detail, listing = REPORT_SHEETS
    owned = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("drawing_id"), "o_orderpriority", "o_orderstatus")
    parts = components(spark, sf_dir).select("drawing_id", "ord", "component_type", "quantity", "length")
    counts = parts.groupBy("drawing_id").agg(F.count("*").alias("n"))
    drawings = owned.join(counts, "drawing_id", "left").fillna(0, ["n"])
    by_owner = Window.partitionBy("owner")
    number = F.row_number().over(by_owner.orderBy("drawing_id"))
    drawn = drawings.select("owner", F.lit(listing).alias("sheet"), (number + 1).cast("long").alias("place"), cells(number, F.concat(F.lit("D-"), "drawing_id"), F.col("o_orderpriority"), F.col("n"), F.col("o_orderstatus")).alias("cells"))
    held = parts.join(owned.select("owner", "drawing_id"), "drawing_id")
    nth = F.row_number().over(by_owner.orderBy("component_type", "drawing_id", "ord", "length"))
    row = cells(F.col("component_type"), F.concat_ws("-", "drawing_id", "ord"), F.col("quantity").cast("long"), at(F.col("length"), 1), q.standard_unit(F.col("component_type")))
    rows = held.select("owner", F.lit(detail).alias("sheet"), (nth + 1).cast("long").alias("place"), row.alias("cells"))
    kinds = held.groupBy("owner", "component_type").agg(F.count("*").alias("n")).groupBy("owner").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    sums = drawings.groupBy("owner").agg(F.count("*").alias("drawings")).join(kinds, "owner", "left").fillna(0)
    head = F.array(
        line(1, "项目", "值"), line(2, "文件路径", F.concat(F.lit("owner-"), "owner")), line(3, "生成时间", ""), line(4, "图纸总数", F.col("drawings")), line(5, "构件总数", F.col("n")), line(6, "构件类型数", F.col("kinds")),
    )
    return sums.select("owner", F.lit(info).alias("sheet"), F.inline(head)).unionByName(sums.select("owner", F.inline(headings({detail: COMPONENT_HEAD, listing: DRAWING_HEAD})))).unionByName(drawn).unionByName(rows)


QUERIES = {f.__name__: f for f in (quantity_workbook, detail_workbook, report_sheets)}


def _case(which: int) -> str:
    return "CASE component_type " + " ".join(f"WHEN '{k}' THEN '{v[which]}'" for k, v in TYPES.items()) + " END"


def _joined(*values: str) -> str:
    return "concat_ws('|', " + ", ".join(values) + ")"


def _at(value: str, decimals: int = 2) -> str:
    return f"round(({value})::DECIMAL(38,9), {decimals})::VARCHAR"



ORACLES = {
    "quantity_workbook": f"""WITH {COMPONENTS_SQL}, v AS (SELECT *, CASE component_type WHEN 'wall' THEN length * height * 0.24::DOUBLE WHEN 'slab' THEN length * width * 0.15::DOUBLE ELSE length * width * height END AS volume,
        CASE component_type WHEN 'wall' THEN length * height WHEN 'beam' THEN width * height ELSE length * width END AS area,
        row_number() OVER (PARTITION BY drawing_id, component_type ORDER BY ord, length, width, material) AS i FROM components WHERE component_type != 'unknown' AND length != 0 AND width != 0),
      t AS (SELECT drawing_id, component_type, count(*) AS n, sum(volume) AS volume, sum(area) AS area FROM v GROUP BY ALL),
      s AS (SELECT drawing_id, sum(n)::BIGINT AS n, sum(volume) AS volume, sum(area) AS area FROM t GROUP BY 1)
      SELECT drawing_id, {_case(1)} AS sheet, i + 3 AS place, {_joined("i", "material", _at("length"), _at("width"), _at("height"), "quantity::BIGINT", _at("volume"), _at("area"))} AS cells FROM v
      UNION ALL SELECT drawing_id, {_case(1)}, n + 5, {_joined("'汇总||||'", "n", _at("volume"), _at("area"))} FROM t UNION ALL SELECT drawing_id, {_case(1)}, 1, {_case(1)} || '明细表' FROM t
      UNION ALL SELECT drawing_id, {_case(1)}, 3, '{PART.join(ITEM_HEAD)}' FROM t UNION ALL SELECT drawing_id, '{TOTALS}', row_number() OVER (PARTITION BY drawing_id ORDER BY list_position({list(TYPES)}, component_type)) + 10, {_joined(_case(0), "n", _at("volume"), _at("area"), "''")} FROM t
      UNION ALL SELECT drawing_id, '{TOTALS}', unnest([1, 3, 4, 5, 6, 7, 10]), unnest(['{TITLE}', '图纸名称|' || drawing_id, '计算时间|', '构件总数|' || n, '总体积(m³)|' || {_at("volume")}, '总面积(m²)|' || {_at("area")}, '{PART.join(TOTAL_HEAD)}']) FROM s""",
    "detail_workbook": f"""WITH {_STD}, i AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY ord, component_type, material, length, width, height) AS i FROM s),
      t AS (SELECT drawing_id, component_type, unit, count(*) AS n, sum(quantity) AS total FROM s GROUP BY ALL)
      SELECT drawing_id, '{DETAIL}' AS sheet, i + 1 AS place, {_joined("drawing_id || '-' || ord", "component_type", "material", _at("length"), _at("width"), _at("height"), _at("quantity", 3), "unit", "CASE WHEN compliant THEN '是' ELSE '否' END", "array_to_string(notes, '; ')")} AS cells FROM i
      UNION ALL SELECT drawing_id, '{SUMMARY}', row_number() OVER (PARTITION BY drawing_id ORDER BY component_type) + 1, {_joined("component_type", "n", _at("total", 3), "unit", _at("total / n", 1))} FROM t
      UNION ALL SELECT DISTINCT drawing_id, unnest(['{DETAIL}', '{SUMMARY}']), 1, unnest(['{PART.join(DETAIL_HEAD)}', '{PART.join(SUMMARY_HEAD)}']) FROM t""",
    "report_sheets": f"""WITH {COMPONENTS_SQL}, o AS (SELECT o_custkey AS owner, o_orderkey AS drawing_id, o_orderpriority, o_orderstatus FROM orders), c AS (SELECT drawing_id, count(*) AS n FROM components GROUP BY 1),
      d AS (SELECT o.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY owner ORDER BY drawing_id) AS i FROM o LEFT JOIN c USING (drawing_id)),
      h AS (SELECT owner, components.*, row_number() OVER (PARTITION BY owner ORDER BY component_type, drawing_id, ord, length) AS i FROM components JOIN o USING (drawing_id)),
      k AS (SELECT owner, (SELECT count(*) FROM h WHERE h.owner = d.owner) AS n, (SELECT count(DISTINCT component_type) FROM h WHERE h.owner = d.owner) AS kinds, count(*) AS drawings FROM d GROUP BY 1)
      SELECT owner, '{REPORT_SHEETS[2]}' AS sheet, i + 1 AS place, {_joined("i", "'D-' || drawing_id", "o_orderpriority", "n", "o_orderstatus")} AS cells FROM d
      UNION ALL SELECT owner, '{REPORT_SHEETS[1]}', i + 1, {_joined("component_type", "drawing_id || '-' || ord", "quantity::BIGINT", _at("length", 1), "CASE WHEN component_type IN ('column', 'beam', 'foundation') THEN 'm³' WHEN component_type IN ('slab', 'wall') THEN 'm²' ELSE '个' END")} FROM h
      UNION ALL SELECT owner, '{REPORT_SHEETS[0]}', unnest([1, 2, 3, 4, 5, 6]), unnest(['项目|值', '文件路径|owner-' || owner, '生成时间|', '图纸总数|' || drawings, '构件总数|' || n, '构件类型数|' || kinds]) FROM k
      UNION ALL SELECT owner, unnest({list(REPORT_SHEETS[1:])}), 1, unnest(['{PART.join(COMPONENT_HEAD)}', '{PART.join(DRAWING_HEAD)}']) FROM k""",
}
