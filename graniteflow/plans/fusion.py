"""Fusion of what several records say of one thing: attributes of components, and changes of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.session import table
from graniteflow.sources.writeback import upserted

#: Attributes that are fused; a component's other fields are its first record's.
ATTRIBUTES = ["dimensions", "reinforcement", "material", "specifications", "notes", "properties", "details"]


def fused_maps(rows: DataFrame, keys: list[str], order: str, attributes: dict[str, str]) -> DataFrame:
    """One row for each key: of each attribute the fused value of the key's records, in the order of ``order``.

    attributes: name to kind. A ``text`` gives the longest, the first of those; a ``map`` gives every key's first value that
    isn't empty, as a map sorted by keys. Empty and null values count as unknown; an attribute that nobody knows is null.
    Maps come apart into rows of key and value, whose first ones combine before the shuffle, and are built again from
    at most one row for each distinct key: no group's maps stand together in a task.
    """
    texts = [a for a, kind in attributes.items() if kind == "text"]
    longest = lambda a: F.max(F.when(F.coalesce(F.col(a), F.lit("")) != "", F.struct(F.char_length(a), (-F.col(order)).alias("turn"), F.col(a))))[a]
    out = rows.groupBy(*keys).agg(F.min(order).alias(order), F.count("*").alias("n"), *[longest(a).alias(a) for a in texts])
    for name in (a for a, kind in attributes.items() if kind == "map"):
        entries = rows.select(*keys, order, F.explode(name).alias("_name", "_value")).where(F.coalesce(F.col("_value").cast("string"), F.lit("")) != "")
        first = entries.groupBy(*keys, "_name").agg(F.min(F.struct(order, "_value"))["_value"].alias("_value"))
        built = first.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "_value")))).alias(name))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        out = out.alias("l").join(built.alias("r"), same, "left").select("l.*", f"r.{name}")
    return out


def quantities_and_sources(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the sum of quantities (1 where unknown) and its sources in the order of their first records, null ones left out."""
    sums = rows.groupBy(*keys).agg(F.sum(F.coalesce("quantity", F.lit(1))).alias("quantity"))
    firsts = rows.where("source IS NOT NULL").groupBy(*keys, "source").agg(F.min(order).alias("_at"))
    listed = firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "source"))), lambda x: x["source"]).alias("sources"))
    return sums.join(listed, keys, "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def component_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as records of components, seen on tiles: two maps and five texts, many of them unknown or empty."""
    key, line, mode = F.col("l_orderkey"), F.col("l_linenumber"), F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string"))
    some = lambda test, value: F.when(test, value)
    sizes = F.create_map(F.lit("width"), some(line % 2 == 0, (F.col("l_partkey") % 900).cast("string")), F.lit("height"), some(line % 3 == 0, (F.col("l_suppkey") % 700).cast("string")), F.lit("length"), F.col("l_quantity").cast("long").cast("string"))
    steel = F.create_map(F.concat(F.lit("d"), (F.col("l_partkey") % 3).cast("string")), some(line % 4 != 1, mode), F.lit("cover"), some(line > 2, F.col("l_returnflag")))
    return table(spark, sf_dir, "lineitem").select(
        (key % 4000).alias("code"), (key * 10 + line).alias("ord"), some(line % 5 != 0, (F.col("l_quantity") % 4).cast("long")).alias("quantity"), some(line % 6 != 0, F.concat(F.lit("tile "), (F.col("l_suppkey") % 6).cast("string"))).alias("source"),
        sizes.alias("dimensions"), some(line % 2 == 1, steel).alias("reinforcement"), some(line % 3 != 0, F.concat(F.lit("steel "), (F.col("l_suppkey") % 13 * 7).cast("string"))).alias("material"), F.when(line % 2 == 0, "").otherwise(mode).alias("specifications"),
        some(line > 5, F.col("l_linestatus")).alias("notes"), F.concat("l_returnflag", F.repeat(F.lit("x"), (F.col("l_partkey") % 5).cast("int"))).alias("properties"), some(key < 0, F.lit("never")).alias("details"),
    )


def _shown(name: str) -> Column:
    """A map as text, by keys."""
    return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def attribute_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each component fused: quantity, sources in order, and of seven attributes the fullest value."""
    rows = component_records(spark, sf_dir)
    kinds = {a: "map" if a in ("dimensions", "reinforcement") else "text" for a in ATTRIBUTES}
    fused = fused_maps(rows, ["code"], "ord", kinds).join(quantities_and_sources(rows, ["code"], "ord"), "code")
    return fused.select("code", "n", F.col("ord").alias("first"), "quantity", F.array_join("sources", ",").alias("sources"), *[(_shown(a) if kind == "map" else F.col(a)).alias(a) for a, kind in kinds.items()])


def changed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after the changes that their lines bring: a new status and priority where the last line says one, and orders that weren't there."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.lit(None).cast("bigint").alias("turn"))
    line, mode = F.col("l_linenumber"), F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string"))
    changes = table(spark, sf_dir, "lineitem").where("l_orderkey % 7 = 0").select(
        F.when(line == 6, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")).alias("o_orderkey"), F.when(line % 2 == 0, F.col("l_linestatus")).alias("o_orderstatus"),
        F.when(line % 3 == 0, mode).alias("o_orderpriority"), line.cast("bigint").alias("turn"),
    )
    return upserted(orders, changes, ["o_orderkey"], "turn")


QUERIES = {f.__name__: f for f in (attribute_fusion, changed_orders)}

_RECORDS = """c AS (SELECT l_orderkey % 4000 AS code, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_linenumber % 5 != 0 THEN (l_quantity % 4)::BIGINT END AS quantity, CASE WHEN l_linenumber % 6 != 0 THEN 'tile ' || l_suppkey % 6 END AS source,
    CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 900 END AS width, CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey % 700 END AS height, l_quantity::BIGINT AS length,
    CASE WHEN l_linenumber % 2 = 1 THEN 'd' || l_partkey % 3 END AS steel, CASE WHEN l_linenumber % 2 = 1 AND l_linenumber % 4 != 1 THEN ('m' || l_partkey % 7) END AS steel_value, CASE WHEN l_linenumber % 2 = 1 AND l_linenumber > 2 THEN l_returnflag END AS cover,
    CASE WHEN l_linenumber % 3 != 0 THEN ('steel ' || l_suppkey % 13 * 7) END AS material, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE ('m' || l_partkey % 7) END AS specifications, CASE WHEN l_linenumber > 5 THEN l_linestatus END AS notes,
    l_returnflag || repeat('x', (l_partkey % 5)::INT) AS properties FROM lineitem)"""
_MAPS = {
    "dimensions": "SELECT code, ord, 'width' AS k, width::VARCHAR AS v FROM c UNION ALL SELECT code, ord, 'height', height::VARCHAR FROM c UNION ALL SELECT code, ord, 'length', length::VARCHAR FROM c",
    "reinforcement": "SELECT code, ord, steel AS k, steel_value AS v FROM c UNION ALL SELECT code, ord, 'cover', cover FROM c",
}
_FUSED = ", ".join(f"{name} AS (SELECT code, string_agg(k || '=' || v, ';' ORDER BY k) AS {name} FROM (SELECT code, k, arg_min(v, (ord, v)) AS v FROM ({union}) WHERE v IS NOT NULL AND v != '' GROUP BY ALL) GROUP BY 1)" for name, union in _MAPS.items())
_LONGEST = ", ".join(f"arg_max({a}, (length({a}), -ord, {a})) FILTER ({a} != '') AS {a}" for a in ("material", "specifications", "notes", "properties"))
ORACLES = {
    "attribute_fusion": f"""WITH {_RECORDS}, {_FUSED}, s AS (SELECT code, string_agg(source, ',' ORDER BY pos, source) AS sources FROM (SELECT code, source, min(ord) AS pos FROM c WHERE source IS NOT NULL GROUP BY ALL) GROUP BY 1),
      t AS (SELECT code, count(*) AS n, min(ord) AS first, sum(coalesce(quantity, 1))::BIGINT AS quantity, {_LONGEST} FROM c GROUP BY 1)
      SELECT code, n, first, quantity, coalesce(sources, '') AS sources, dimensions, reinforcement, material, specifications, notes, properties, NULL::VARCHAR AS details FROM t LEFT JOIN s USING (code) LEFT JOIN dimensions USING (code) LEFT JOIN reinforcement USING (code)""",
    "changed_orders": """WITH c AS (SELECT CASE WHEN l_linenumber = 6 THEN -l_orderkey - 1 ELSE l_orderkey END AS o_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS s, CASE WHEN l_linenumber % 3 = 0 THEN ('m' || l_partkey % 7) END AS p, l_linenumber AS turn FROM lineitem WHERE l_orderkey % 7 = 0),
      n AS (SELECT o_orderkey, arg_max(s, (turn, s)) FILTER (s IS NOT NULL) AS s, arg_max(p, (turn, p)) FILTER (p IS NOT NULL) AS p, max(turn)::BIGINT AS turn FROM c GROUP BY 1)
      SELECT o_orderkey, coalesce(s, o_orderstatus) AS o_orderstatus, coalesce(p, o_orderpriority) AS o_orderpriority, turn FROM orders FULL JOIN n USING (o_orderkey)""",
}
