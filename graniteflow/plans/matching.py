"""First matches, choices among conflicting candidates, comparisons of two sources, sessions and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteflow.functions.keys import falling, packed, unpacked
from graniteflow.plans.events import events
from graniteflow.plans.takeoff import COMPONENTS_SQL, components
from graniteflow.session import table

#: Type of a line number.
LINE = "int"


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the candidates for a part the most certain one; ties go to the least order and line, then supplier."""
    c = 100 - F.round(F.col("l_discount") * 100).cast("long")
    order, line, supplier = (falling(F.col(n), d) for n, d in (("l_orderkey", 12), ("l_linenumber", 2), ("l_suppkey", 10)))
    best = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(packed((c, 3), (order, 12), (line, 2), (supplier, 10))).alias("_k"), F.count("*").alias("n"))
    c, order, line, supplier = unpacked(F.col("_k"), 3, 12, 2, 10)
    return best.select("l_partkey", falling(order, 12).alias("l_orderkey"), falling(line, 2).cast(LINE).alias("l_linenumber"), falling(supplier, 10).alias("l_suppkey"), c.alias("c"), "n")


def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their first line item, if any, and their owner's name; line items are reduced before the join."""
    key = packed((F.col("l_linenumber"), 2), (F.col("l_partkey"), 12))
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(key).alias("_k"))
    line, part = unpacked(F.col("_k"), 2, 12)
    first = first.select("o_orderkey", line.cast(LINE).alias("line"), part.alias("part"))
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(first, "o_orderkey", "left").join(owners, "o_custkey", "left")
    return rows.select("o_orderkey", "c_name", "line", "part")


def source_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of even and odd slices by type, side by side, with the difference."""
    even, odd = (F.count_if(F.col("slice_index") % 2 == k) for k in (0, 1))
    return components(spark, sf_dir).groupBy("component_type").agg(even.alias("even"), odd.alias("odd"), (even - odd).alias("difference"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user end after 30 minutes without an event."""
    rows = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return rows.select("user_id", F.col("w.start").alias("first_ts"), "last_ts", "n")


def failure_rate_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with ten events and more of which over a fifth are errors."""
    hours = events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failure").alias("failed"))
    return hours.where("n >= 10 AND failed * 5 > n")


def newest_connections(spark: SparkSession, sf_dir: str, most: int = 5) -> DataFrame:
    """The newest ``most`` events of each user; the cap is the feature."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, sf_dir).select("user_id", "event_id", F.row_number().over(order).alias("place")).where(F.col("place") <= most)


QUERIES = {f.__name__: f for f in (best_candidate, first_match, source_comparison, user_sessions, failure_rate_alerts, newest_connections)}
ORACLES = {
    "best_candidate": """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, c, n FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS n,
      row_number() OVER (PARTITION BY l_partkey ORDER BY c DESC, l_orderkey, l_linenumber, l_suppkey) AS r FROM (SELECT *, 100 - round(l_discount * 100)::BIGINT AS c FROM lineitem)) WHERE r = 1""",
    "first_match": """SELECT o_orderkey, c_name, l_linenumber AS line, l_partkey AS part FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN
      (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) ON l_orderkey = o_orderkey AND r = 1""",
    "source_comparison": f"WITH {COMPONENTS_SQL} SELECT component_type, count(*) FILTER (slice_index % 2 = 0) AS even, count(*) FILTER (slice_index % 2 = 1) AS odd, even - odd AS difference FROM components GROUP BY 1",
    "user_sessions": """SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
      FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
    "failure_rate_alerts": "SELECT * FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1) WHERE n >= 10 AND failed * 5 > n",
    "newest_connections": "SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS place FROM events) WHERE place <= 5",
}
