"""What exports are made of: gated and numbered rows, sheets as arrays of strings, JSON lines, reports, formulas by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteflow.functions import quantities as q
from graniteflow.plans.monitoring import HOURS, now, stamped
from graniteflow.plans.takeoff import COMPONENTS_SQL, components
from graniteflow.session import table

#: Most drawings in one batch export.
BATCH = 10
#: Weights of a frame's sub-scores, and scores from which it is good, fair and poor.
FRAME_WEIGHTS, FRAME_CLASSES = (3.0, 2.0, 2.5, 1.5, 1.0), ((7, "high"), (5, "medium"), (3, "low"))
SIZE_SCORES = {"exact": 1.0, "approximate": 0.7, "relaxed": 0.3, "text_derived": 0.3, "density_derived": 0.3}


def shown(value: Column, decimals: int) -> Column:
    """A number with so many decimals, '-' for 0 and null."""
    text = F.format_string(f"%.{decimals}f", F.round(value, decimals))
    return F.when(F.coalesce(value, F.lit(0.0)) == 0, "-").otherwise(text)


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of finished orders with at least one line item, as an export shows them: whole and rounded values as text."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey").join(lines, "o_orderkey")
    return rows.select("o_orderkey", "n", shown(F.col("quantity"), 2).alias("quantity"), shown(F.col("n") - 1.0, 0).alias("others"))


def batch_export(spark: SparkSession, sf_dir: str, ids: tuple[int, ...] = (1, 2, 3, 5, 8, 13, 10**9)) -> DataFrame:
    """Line items of a few orders by id, tagged with the order, in one scan; unknown ids have an error."""
    if len(ids) > BATCH:
        raise ValueError(f"more than {BATCH} ids")
    asked = spark.createDataFrame([(i,) for i in ids], "l_orderkey long")
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey").isin(*ids)).select("l_orderkey", "l_linenumber", "l_quantity")
    return asked.join(rows, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_linenumber").isNull(), "no data").alias("error"))


def numbered_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of each drawing on sheets by type in the workbook's order, numbered from 1."""
    place = F.array_position(F.array(*[F.lit(k) for k in ("wall", "column", "beam", "slab", "foundation")]), F.col("component_type"))
    order = Window.partitionBy("drawing_id", "component_type").orderBy("ord", "length", "width", "material", "slice_index")
    rows = components(spark, sf_dir).where(place > 0)
    return rows.select("drawing_id", place.cast("int").alias("sheet"), F.row_number().over(order).alias("number"), "ord", "length")


def sheet_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary sheet as rows of cells: a heading, a row for each type and the total."""
    rows = components(spark, sf_dir).rollup("component_type").agg(F.count("*").alias("n"), F.sum("quantity").cast("long").alias("quantity"))
    cells = F.array(F.coalesce("component_type", F.lit("总计")), F.col("n").cast("string"), F.col("quantity").cast("string"))
    head = spark.createDataFrame([(0, ["类型", "数量", "工程量"])], "place int, cells array<string>")
    place = F.when(F.col("component_type").isNull(), 2).otherwise(1)
    return head.union(rows.select(place, cells)).select("place", F.array_join("cells", "|").alias("cells"))


def error_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the window as lines of JSON."""
    rows = stamped(spark, sf_dir).where("event_type = 'error'").where(F.col("ts") >= now() - F.expr(f"INTERVAL {HOURS} HOURS"))
    return rows.select("event_id", F.to_json(F.struct("event_id", "user_id", "category", "level")).alias("line"))


def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a report: a line for each turn, its number, role and length."""
    line = F.concat(F.lit("["), "turn", F.lit("] "), "role", F.lit(": "), F.length("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("_l"))
    return rows.groupBy("conv_id").agg(F.concat(F.lit("# "), F.first("conv_id"), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["line"]), "\n")).alias("report"))


def overview_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand a sentence: parts, kinds and the largest size, joined by semicolons; empty parts are left out."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("kinds"), F.max("p_size").alias("most"))
    large = F.when(F.col("most") > 45, F.concat(F.lit("最大尺寸"), "most"))
    return rows.select("p_brand", F.concat_ws("；", F.concat(F.lit("构件"), "n", F.lit("个")), F.concat(F.lit("类型"), "kinds", F.lit("种")), large).alias("sentence"))


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components joined with the table of standard rules; types without one get the default row. The rules are six rows."""
    rules = spark.createDataFrame([(k, measure, unit, factor) for k, (measure, unit, factor) in q.STANDARD_RULES.items()], "component_type string, measure string, unit string, factor double")
    rows = components(spark, sf_dir).groupBy("component_type").agg(F.count("*").alias("n"))
    both = rows.join(F.broadcast(rules), "component_type", "left")
    return both.select("component_type", "n", F.coalesce("measure", F.lit("none")).alias("measure"), F.coalesce("unit", F.lit(q.NO_UNIT)).alias("unit"), F.coalesce("factor", F.lit(0.0)).alias("factor"), F.col("measure").isNotNull().alias("ruled"))


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a candidate for a drawing's frame: weighted sum of its sub-scores and its class."""
    key = F.col("p_partkey")
    match = F.get(F.array(*map(F.lit, [*SIZE_SCORES, "none"])), (key % 6).cast("int"))
    size = F.coalesce(*[F.when(match == k, v) for k, v in SIZE_SCORES.items()], F.lit(0.0))
    parts = [size, (key % 4 / 3).cast("double"), (key % 5 / 4).cast("double"), (key % 3 / 2).cast("double"), (key % 2).cast("double")]
    total = sum((p * w for p, w in zip(parts, FRAME_WEIGHTS, strict=True)), F.lit(0.0))
    rows = table(spark, sf_dir, "part").select("p_partkey", match.alias("match"), F.round(total, 6).alias("score"))
    return rows.withColumn("class", F.coalesce(*[F.when(F.col("score") >= least, name) for least, name in FRAME_CLASSES], F.lit("rejected")))


def visible_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten users last active, if within ten days of the report; a top-k report."""
    rows = stamped(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("seen"), F.count("*").alias("n"))
    return rows.where(F.col("seen") >= now() - F.expr(f"INTERVAL {HOURS} HOURS")).orderBy(F.desc("seen"), "user_id").limit(10).select("user_id", "n")


QUERIES = {
    f.__name__: f
    for f in (export_rows, batch_export, numbered_workbook, sheet_arrays, error_export, text_report, overview_sentences, rule_table, frame_scores, visible_tasks)
}
_SIZE = "CASE match " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SIZE_SCORES.items()) + " ELSE 0 END::DOUBLE"
ORACLES = {
    "export_rows": """SELECT o_orderkey, n, CASE WHEN quantity = 0 THEN '-' ELSE printf('%.2f', round(quantity, 2)) END AS quantity, CASE WHEN n = 1 THEN '-' ELSE (n - 1)::VARCHAR END AS others FROM orders
      JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""",
    "batch_export": "SELECT i AS l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber IS NULL THEN 'no data' END AS error FROM unnest([1, 2, 3, 5, 8, 13, 1000000000]::BIGINT[]) AS u(i) LEFT JOIN lineitem ON l_orderkey = i",
    "numbered_workbook": f"""WITH {COMPONENTS_SQL}, p AS (SELECT *, list_position(['wall', 'column', 'beam', 'slab', 'foundation'], component_type) AS sheet FROM components)
      SELECT drawing_id, sheet::INT AS sheet, row_number() OVER (PARTITION BY drawing_id, component_type ORDER BY ord, length, width, material, slice_index)::INT AS number, ord, length FROM p WHERE sheet IS NOT NULL""",
    "sheet_arrays": f"""WITH {COMPONENTS_SQL} SELECT 0 AS place, '类型|数量|工程量' AS cells UNION ALL SELECT CASE WHEN component_type IS NULL THEN 2 ELSE 1 END, coalesce(component_type, '总计') || '|' || count(*) || '|' || sum(quantity)::BIGINT FROM components GROUP BY ROLLUP (component_type)""",
    "error_export": f"""SELECT event_id, to_json({{'event_id': event_id, 'user_id': user_id, 'category': ['network', 'parsing', 'storage'][json_extract_string(props, '$.k')::INT % 3 + 1],
      'level': CASE WHEN value > 90 THEN 'critical' WHEN value > 50 THEN 'error' ELSE 'warning' END}})::VARCHAR AS line FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL {HOURS} HOUR""",
    "text_report": "SELECT conv_id, '# ' || conv_id || chr(10) || string_agg('[' || turn || '] ' || role || ': ' || length(text), chr(10) ORDER BY turn, '[' || turn || '] ' || role || ': ' || length(text)) AS report FROM conversations GROUP BY 1",
    "overview_sentences": """SELECT p_brand, concat_ws('；', '构件' || count(*) || '个', '类型' || count(DISTINCT p_type) || '种', CASE WHEN max(p_size) > 45 THEN '最大尺寸' || max(p_size) END) AS sentence FROM part GROUP BY 1""",
    "rule_table": f"""WITH {COMPONENTS_SQL} SELECT component_type, count(*) AS n, CASE WHEN component_type IN ('column', 'beam', 'foundation') THEN 'volume' WHEN component_type IN ('slab', 'wall') THEN 'area' ELSE 'none' END AS measure,
      CASE WHEN component_type IN ('column', 'beam', 'foundation') THEN 'm³' WHEN component_type IN ('slab', 'wall') THEN 'm²' ELSE '个' END AS unit, CASE WHEN component_type = 'unknown' THEN 0 ELSE 1 END::DOUBLE AS factor, component_type != 'unknown' AS ruled FROM components GROUP BY 1""",
    "frame_scores": f"""WITH k AS (SELECT p_partkey, {[*SIZE_SCORES, 'none']}[p_partkey % 6 + 1] AS match FROM part), s AS (SELECT p_partkey, match, round({_SIZE} * 3 + p_partkey % 4 / 3 * 2 + p_partkey % 5 / 4 * 2.5::DOUBLE + p_partkey % 3 / 2 * 1.5::DOUBLE + p_partkey % 2, 6) AS score FROM k)
      SELECT p_partkey, match, score, CASE WHEN score >= 7 THEN 'high' WHEN score >= 5 THEN 'medium' WHEN score >= 3 THEN 'low' ELSE 'rejected' END AS class FROM s""",
    "visible_tasks": f"SELECT user_id, n FROM (SELECT user_id, max(ts) AS seen, count(*) AS n FROM events GROUP BY 1) WHERE seen >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL {HOURS} HOUR ORDER BY seen DESC, user_id LIMIT 10",
}
