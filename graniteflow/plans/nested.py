"""JSON in texts, nested records, conversation windows, batches and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteflow.functions import nested as n
from graniteflow.session import table

#: Turns of a conversation that a request carries, and those that a step sees.
RECENT, STEP_TURNS = 10, 6


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties as a model may give them back: plain, fenced, within prose, in single quotes, or no JSON at all."""
    props, key = F.col("props"), F.col("event_id") % 5
    text = (
        F.when(key == 0, props).when(key == 1, F.concat(F.lit("Here:\n```json\n"), props, F.lit("\n```\nDone."))).when(key == 2, F.concat(F.lit("note "), props, F.lit(" end")))
        .when(key == 3, F.replace(props, F.lit('"'), F.lit("'"))).otherwise("no json")
    )
    return table(spark, sf_dir, "events").select("event_id", "event_type", text.alias("text"))


def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value k of every reply, -1 where there is none, and how it was found."""
    rows = replies(spark, sf_dir).select("event_id", n.reply(F.col("text")).alias("_v"), F.col("text").contains("```").alias("fenced"))
    return rows.select("event_id", F.coalesce(F.try_variant_get("_v", "$.k", "int"), F.lit(-1)).alias("k"), F.col("_v").isNotNull().alias("parsed"), "fenced")


def reply_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of each event type: how many could be read, their share, and good, fair or limited by their number."""
    rows = replies(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count(n.reply(F.col("text"))).alias("read"))
    grade = F.when(F.col("read") >= 1600, "good").when(F.col("read") >= 800, "fair").otherwise("limited")
    return rows.select("event_type", "n", "read", F.round(F.col("read") / F.col("n"), 6).alias("rate"), grade.alias("grade"))


def parsed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's place from a list, an object or other text."""
    key = F.col("p_partkey")
    number = lambda c: c.cast("string")
    text = F.when(key % 3 == 0, F.concat(F.lit("["), number(key), F.lit(", 2, "), number(F.col("p_size").cast("int")), F.lit(", 4]"))).when(
        key % 3 == 1, F.concat(F.lit('{"x": '), number(key), F.lit(', "y": 7, "width": 1.5}'))
    ).otherwise(F.concat(F.lit("near "), number(key)))
    return table(spark, sf_dir, "part").select("p_partkey", n.position(text).alias("_p")).select("p_partkey", "_p.*")


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored result for each supplier: components as JSON, in an array of an object; some empty, some under another name, some broken."""
    key = F.col("s_suppkey")
    item = lambda i: F.concat(F.lit('{"id": "'), F.when(i == 2, "").otherwise(F.concat(F.lit("KZ-"), i)), F.lit('", "type": "column", "quantity": '), key % 7 + i, F.lit("}"))
    items = F.array_join(F.transform(F.sequence(F.lit(1), (key % 4 + 1).cast("int")), item), ", ")
    text = F.when(key % 11 == 0, "{broken").when(key % 5 == 0, F.concat(F.lit('{"final_components": [], "components": ['), items, F.lit("]}"))).otherwise(F.concat(F.lit('{"final_components": ['), items, F.lit("]}")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("result"))


def component_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each stored component with its place; the first array that isn't empty counts, ids that are empty go."""
    found = n.stored(F.col("result"))
    rows = documents_of(spark, sf_dir).select("s_suppkey", F.posexplode(n.first_held(found["final_components"], found["components"])).alias("place", "_c"))
    return rows.where("_c.id != ''").select("s_suppkey", "place", "_c.id", "_c.type", F.coalesce("_c.quantity", F.lit(1.0)).alias("quantity"), F.coalesce("_c.confidence", F.lit(0.8)).alias("confidence"))


def stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each stored result could be read, and how many components it has."""
    found = n.stored(F.col("result"))
    return documents_of(spark, sf_dir).select("s_suppkey", found["final_components"].isNotNull().alias("readable"), F.size(n.first_held(found["final_components"], found["components"])).alias("components"))


def cleaned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every part as a map without empty ones, as text, and which of the required ones are missing."""
    key = F.col("p_partkey")
    fields = F.create_map(F.lit("name"), F.concat(F.lit(" "), "p_name"), F.lit("brand"), F.when(key % 3 != 0, F.col("p_brand")), F.lit("note"), F.when(key % 2 == 0, "").otherwise("x"))
    held = n.without_empty(fields)
    missing = F.filter(F.array(F.lit("name"), F.lit("brand"), F.lit("note")), lambda k: ~F.map_contains_key(held, k))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(held)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"), F.array_join(missing, ",").alias("missing"))


def conversation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that go into a request: the last system turn and the last RECENT others of each conversation; the cap is the feature."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.col("role") == "system").alias("system"))
    order = Window.partitionBy("conv_id", "system").orderBy(F.desc("turn"))
    return rows.withColumn("back", F.row_number().over(order)).where(F.col("back") <= F.when(F.col("system"), 1).otherwise(RECENT)).select("conv_id", "turn", "role", "back")


def step_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last STEP_TURNS roles of each conversation, in order, and the last assistant turn."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(order).alias("back")).where(F.col("back") <= STEP_TURNS)
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return last.groupBy("conv_id").agg(roles.alias("roles"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_answer"))


def context_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn sees of those before it: how many, their characters, and the role just before."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.count("*").over(before).alias("seen"), F.coalesce(F.sum(length).over(before), F.lit(0)).alias("characters"), F.lag("role").over(order).alias("after"))


def batches_of_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in batches of eight, by time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.floor((F.row_number().over(order) - 1) / 8).cast("int").alias("batch"))


def fallback_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of the first result that passes its gate, and its value: four levels, else none."""
    key, value = F.col("event_id"), F.col("value")
    gates = [("dual_track", (value > 90) & (key % 2 == 0)), ("sliced", value > 70), ("direct", key % 3 == 0), ("text_only", value > 20)]
    level = F.coalesce(*[F.when(test, name) for name, test in gates], F.lit("none"))
    rate = F.coalesce(*[F.when(test, F.lit(0.9 - 0.2 * i)) for i, (_, test) in enumerate(gates)], F.lit(0.0))
    return table(spark, sf_dir, "events").groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.round(F.sum(rate), 4).alias("weight"))


def synthetic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose ids count from 1 without a gap, three at least, or that have one prefix only: signs of made-up data."""
    ids = component_rows(spark, sf_dir).groupBy("s_suppkey").agg(
        F.count("*").alias("n"), F.min(F.substring_index("id", "-", -1).cast("int")).alias("low"), F.max(F.substring_index("id", "-", -1).cast("int")).alias("high"),
        F.count_distinct("id").alias("ids"), F.count_distinct(F.substring_index("id", "-", 1)).alias("prefixes"),
    )
    run = (F.col("n") >= 3) & (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("ids") == F.col("n"))
    return ids.select("s_suppkey", run.alias("counted"), ((F.col("n") > 2) & (F.col("prefixes") == 1)).alias("one_prefix"))


QUERIES = {
    f.__name__: f
    for f in (
        fenced_json, reply_quality, parsed_positions, component_rows, stored_counts, cleaned_records, conversation_window, step_context, context_chain, batches_of_eight, fallback_levels, synthetic_ids,
    )
}
_D = """d AS (SELECT s_suppkey, s_suppkey % 4 + 1 AS n, s_suppkey % 11 = 0 AS broken FROM supplier),
  c AS (SELECT s_suppkey, (i - 1)::INT AS place, CASE WHEN i = 2 THEN '' ELSE 'KZ-' || i END AS id, 'column' AS type, (s_suppkey % 7 + i)::DOUBLE AS quantity, 0.8::DOUBLE AS confidence FROM d, unnest(range(1, n + 1)) AS u(i) WHERE NOT broken),
  k AS (SELECT * FROM c WHERE id != '')"""
ORACLES = {
    "fenced_json": "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN -1 ELSE json_extract_string(props, '$.k')::INT END AS k, event_id % 5 != 4 AS parsed, event_id % 5 = 1 AS fenced FROM events",
    "reply_quality": """SELECT event_type, n, read, round(read / n, 6) AS rate, CASE WHEN read >= 1600 THEN 'good' WHEN read >= 800 THEN 'fair' ELSE 'limited' END AS grade
      FROM (SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 5 != 4) AS read FROM events GROUP BY 1)""",
    "parsed_positions": """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_partkey END::DOUBLE AS x, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 7 END::DOUBLE AS y, CASE p_partkey % 3 WHEN 0 THEN p_size::INT WHEN 1 THEN 1.5 END::DOUBLE AS width,
      CASE WHEN p_partkey % 3 = 0 THEN 4 END::DOUBLE AS height, CASE WHEN p_partkey % 3 = 2 THEN 'near ' || p_partkey END AS raw FROM part""",
    "component_rows": f"WITH {_D} SELECT s_suppkey, place, id, type, quantity, confidence FROM k",
    "stored_counts": f"WITH {_D} SELECT s_suppkey, NOT broken AS readable, CASE WHEN broken THEN 0 ELSE n END::INT AS components FROM d",
    "cleaned_records": """SELECT p_partkey, concat_ws(';', CASE WHEN p_partkey % 3 != 0 THEN 'brand=' || p_brand END, 'name=' || trim(p_name), CASE WHEN p_partkey % 2 = 1 THEN 'note=x' END) AS fields,
      concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'brand' END, CASE WHEN p_partkey % 2 = 0 THEN 'note' END) AS missing FROM part""",
    "conversation_window": f"""SELECT conv_id, turn, role, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC)::INT AS back FROM conversations)
      WHERE back <= CASE WHEN role = 'system' THEN 1 ELSE {RECENT} END""",
    "step_context": f"""SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, max(turn) FILTER (role = 'assistant') AS last_answer
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= {STEP_TURNS} GROUP BY 1""",
    "context_chain": """SELECT conv_id, turn, count(*) OVER w AS seen, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS characters, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "batches_of_eight": "SELECT event_id, user_id, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8)::INT AS batch FROM events",
    "fallback_levels": """SELECT level, count(*) AS n, round(sum(CASE level WHEN 'dual_track' THEN 0.9 WHEN 'sliced' THEN 0.7 WHEN 'direct' THEN 0.5 WHEN 'text_only' THEN 0.3 ELSE 0 END::DOUBLE), 4) AS weight
      FROM (SELECT CASE WHEN value > 90 AND event_id % 2 = 0 THEN 'dual_track' WHEN value > 70 THEN 'sliced' WHEN event_id % 3 = 0 THEN 'direct' WHEN value > 20 THEN 'text_only' ELSE 'none' END AS level FROM events) GROUP BY 1""",
    "synthetic_ids": f"""WITH {_D} SELECT s_suppkey, count(*) >= 3 AND min(split_part(id, '-', 2)::INT) = 1 AND max(split_part(id, '-', 2)::INT) = count(*) AND count(DISTINCT id) = count(*) AS counted,
      count(*) > 2 AND count(DISTINCT split_part(id, '-', 1)) = 1 AS one_prefix FROM k GROUP BY 1""",
}
