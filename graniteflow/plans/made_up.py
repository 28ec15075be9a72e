"""Signs of made-up results: marker phrases, ids that count up, one prefix for all, one value for most dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteflow.session import table

#: Phrases that made-up project names and titles hold, and prefixes whose numbers count up.
MARKERS = [
    "某建筑工程项目", "某建筑结构施工图", "某住宅楼", "某办公楼", "示例项目", "测试项目", "演示项目", "样例工程", "XX项目", "XXX工程", "demo", "example", "test",
    "某建筑", "某项目", "某工程", "某结构", "标题栏显示的", "图纸上的", "图纸标注的", "标题栏中的项目名称", "项目名称", "工程名称",
]
COUNTED = ["KZ-", "L-", "B-"]
#: A run or a single prefix needs so many ids; one value is suspect over this share of more than this many dimensions.
RUN, SHARE, VALUES = 3, 0.6, 5


def marked(*texts: Column) -> Column:
    """Whether a text holds a marker phrase, in any case; null texts hold none."""
    found = [F.coalesce(F.contains(F.lower(t), F.lit(m.lower())), F.lit(False)) for t in texts for m in MARKERS]
    return reduce(Column.__or__, found)


def signs(results: DataFrame, components: DataFrame) -> DataFrame:
    """Of each result: whether it is marked, counted, has one prefix, has one value, and whether it is any of these.

    results: result, project, title; components: result, place (in the result), id, width, height, length. A result is
    counted if its ids of one prefix, in order of place, are prefix1, prefix2 and so on, three at least. One prefix: all
    ids with a hyphen have the same text before it, among three components or more; an id without one doesn't count. Of dimensions, null
    and 0 aren't values. A null id is ''. Components of results that aren't in ``results`` are left out; repeated results give repeated rows.
    Only the numbering of a prefix's ids needs a result's rows in order; all else combines before the shuffle.
    """
    parts = components.where("result IS NOT NULL").withColumn("id", F.coalesce("id", F.lit("")))
    sizes = parts.groupBy("result").agg(
        F.count("*").alias("n"), F.min(F.when(F.contains("id", F.lit("-")), F.substring_index("id", "-", 1))).alias("low"), F.max(F.when(F.contains("id", F.lit("-")), F.substring_index("id", "-", 1))).alias("high"),
    )
    prefix = F.coalesce(*[F.when(F.startswith(F.col("id"), F.lit(p)), p) for p in COUNTED])
    ordered = parts.withColumn("prefix", prefix).where("prefix IS NOT NULL").withColumn("number", F.row_number().over(Window.partitionBy("result", "prefix").orderBy("place", "id")))
    runs = ordered.groupBy("result", "prefix").agg(F.count("*").alias("held"), F.count_if(F.col("id") == F.concat("prefix", F.col("number").cast("string"))).alias("counted"))
    runs = runs.groupBy("result").agg(F.max((F.col("held") >= RUN) & (F.col("held") == F.col("counted"))).alias("counted"))
    values = parts.select("result", F.explode(F.array("width", "height", "length")).alias("value")).where("value != 0").groupBy("result", "value").agg(F.count("*").alias("held"))
    values = values.groupBy("result").agg(F.sum("held").alias("all"), F.max("held").alias("most"))
    whole = results.join(sizes, "result", "left").join(runs, "result", "left").join(values, "result", "left")
    found = {
        "marked": marked(F.col("project"), F.col("title")),
        "counted": F.coalesce("counted", F.lit(False)) & (F.col("n") >= RUN),
        "one_prefix": F.coalesce((F.col("low") == F.col("high")) & (F.col("n") >= RUN), F.lit(False)),
        "one_value": F.coalesce((F.col("all") > VALUES) & (F.col("most") > F.col("all") * SHARE), F.lit(False)),
    }
    out = whole.select("result", *[c.alias(name) for name, c in found.items()])
    return out.withColumn("made_up", reduce(Column.__or__, map(F.col, found)))


def results_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as results, whose project names are made up here and there, and line items as their components."""
    key, line = F.col("o_orderkey"), F.col("l_linenumber")
    project = F.when(key % 17 == 0, "A Demo tower").when(key % 19 == 0, "某住宅楼 3").when(key % 23 != 0, F.concat(F.lit("Tower "), "o_custkey"))
    results = table(spark, sf_dir, "orders").select(key.alias("result"), project.alias("project"), F.when(key % 29 == 0, "TEST sheet").otherwise(F.col("o_orderpriority")).alias("title"))
    order = F.col("l_orderkey")
    ident = F.when(order % 5 == 0, F.concat(F.lit("KZ-"), line)).when(order % 5 == 1, F.concat(F.element_at(F.array(*map(F.lit, ["L-", "B-", "Q"])), (line % 3 + 1).cast("int")), line)).otherwise(F.concat(F.lit("B-"), F.col("l_partkey")))
    parts = table(spark, sf_dir, "lineitem").select(
        order.alias("result"), (line * 10_000 + F.col("l_partkey") % 10_000).alias("place"), ident.alias("id"),
        F.when(order % 3 == 0, 0.3).otherwise(F.col("l_discount")).alias("width"), F.when(order % 4 == 0, 0.3).otherwise(F.col("l_tax")).alias("height"), F.col("l_quantity").alias("length"),
    )
    return results, parts


def synthetic_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order as a result, which signs of made-up data it has."""
    return signs(*results_of(spark, sf_dir))


QUERIES = {"synthetic_signs": synthetic_signs}
_HIT = " OR ".join(f"contains(lower({{0}}), '{m.lower()}')" for m in MARKERS)
ORACLES = {
    "synthetic_signs": f"""WITH r AS (SELECT o_orderkey AS result, CASE WHEN o_orderkey % 17 = 0 THEN 'A Demo tower' WHEN o_orderkey % 19 = 0 THEN '某住宅楼 3' WHEN o_orderkey % 23 != 0 THEN 'Tower ' || o_custkey END AS project,
        CASE WHEN o_orderkey % 29 = 0 THEN 'TEST sheet' ELSE o_orderpriority END AS title FROM orders),
      c AS (SELECT l_orderkey AS result, l_linenumber * 10000 + l_partkey % 10000 AS place, CASE l_orderkey % 5 WHEN 0 THEN 'KZ-' || l_linenumber WHEN 1 THEN ['L-', 'B-', 'Q'][l_linenumber % 3 + 1] || l_linenumber ELSE 'B-' || l_partkey END AS id,
        CASE WHEN l_orderkey % 3 = 0 THEN 0.3 ELSE l_discount END::DOUBLE AS width, CASE WHEN l_orderkey % 4 = 0 THEN 0.3 ELSE l_tax END::DOUBLE AS height, l_quantity AS length FROM lineitem),
      l AS (SELECT result, list(id ORDER BY place, id) AS ids, list_filter(flatten(list([width, height, length])), lambda x: x != 0) AS v FROM c GROUP BY 1),
      k AS (SELECT *, len(ids) AS n, list_filter(ids, lambda x: starts_with(x, 'KZ-')) AS a, list_filter(ids, lambda x: starts_with(x, 'L-')) AS b, list_filter(ids, lambda x: starts_with(x, 'B-')) AS d,
        list_distinct(list_transform(list_filter(ids, lambda x: contains(x, '-')), lambda x: split_part(x, '-', 1))) AS prefixes, list_aggregate(list_transform(list_distinct(v), lambda x: len(list_filter(v, lambda y: y = x))), 'max') AS most FROM l),
      s AS (SELECT result, coalesce({_HIT.format("project")}, false) OR coalesce({_HIT.format("title")}, false) AS marked,
        coalesce(n >= 3 AND (len(a) >= 3 AND a = list_transform(range(1, len(a) + 1), lambda i: 'KZ-' || i) OR len(b) >= 3 AND b = list_transform(range(1, len(b) + 1), lambda i: 'L-' || i) OR len(d) >= 3 AND d = list_transform(range(1, len(d) + 1), lambda i: 'B-' || i)), false) AS counted,
        coalesce(n >= 3 AND len(prefixes) = 1, false) AS one_prefix, coalesce(len(v) > 5 AND most > len(v) * 0.6::DOUBLE, false) AS one_value FROM r LEFT JOIN k USING (result))
      SELECT *, marked OR counted OR one_prefix OR one_value AS made_up FROM s""",
}
