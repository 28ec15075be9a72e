"""Queries over text content, greedy de-duplication of boxes and windowed alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.functions.text import PATTERNS, letters_alike, text_type
from graniteflow.operators.greedy import greedy_selection, overlap_edges
from graniteflow.plans.layout import boxes
from graniteflow.plans.merging import greedy_sql
from graniteflow.session import table
from graniteflow.streaming import alerts


def token_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents by type. Equal words are counted first, then typed."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))
    return words.groupBy(text_type(F.col("word")).alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))


def name_kind_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the characters of a part's name and type are, averaged by type."""
    alike = letters_alike(F.col("p_name"), F.lower("p_type"))
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.round(F.avg(alike), 6).alias("likeness"), F.count("*").alias("n"))


def turn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation: turns, characters, and the role of its last turn."""
    last = F.max_by("role", F.struct("turn", "role")).alias("last_role")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("n_chars"), last)


def greedy_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in id order; one that overlaps a kept one of its sheet's group by over 0.05 is removed, equal boxes first."""
    rows = boxes(spark, sf_dir).groupBy(F.concat_ws("|", "sheet", "grp").alias("grp"), "x1", "y1", "x2", "y2").agg(F.min("id").alias("id"))
    return greedy_selection(rows, overlap_edges(rows, 0.05))


def error_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alerts(table(spark, sf_dir, "events"))


QUERIES = {f.__name__: f for f in (token_types, name_kind_likeness, turn_summary, greedy_boxes, error_alerts)}
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(trim(word), '{p}') THEN '{k}'" for k, p in PATTERNS.items()) + " ELSE 'unknown' END"
_SET = "list_distinct(string_split({}, ''))"
ORACLES = {
    "token_types": f"SELECT {_KIND} AS kind, count(*) AS n, count(DISTINCT word) AS n_distinct FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE word != '' GROUP BY 1",
    "name_kind_likeness": f"""SELECT p_type, round(avg(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6) AS likeness, count(*) AS n
      FROM (SELECT p_type, {_SET.format('p_name')} AS a, {_SET.format('lower(p_type)')} AS b FROM part) GROUP BY 1""",
    "turn_summary": "SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS n_chars, arg_max(role, (turn, role)) AS last_role FROM conversations GROUP BY 1",
    "greedy_boxes": f"""WITH RECURSIVE b AS (SELECT p_partkey AS id, p_partkey // 2000 || '|' || p_brand AS grp, p_partkey * 37 % 2000 AS x1, p_partkey * 53 % 2000 AS y1,
        p_partkey * 37 % 2000 + 10 + p_size AS x2, p_partkey * 53 % 2000 + 10 + p_size % 20 AS y2 FROM part), n AS (SELECT grp, x1, y1, x2, y2, min(id) AS id FROM b GROUP BY ALL),
      q AS (SELECT a.grp, a.id AS low, c.id AS high, greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS shared,
        (a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS area FROM n a JOIN n c ON a.grp = c.grp AND a.id < c.id),
      edges AS (SELECT grp, low, high FROM q WHERE shared / (area - shared) > 0.05), {greedy_sql('n', 'edges')} SELECT id, is_kept AS kept FROM seeded""",
    "error_alerts": """SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start
      FROM events WHERE event_type = 'error') GROUP BY 1 HAVING count(*) >= 3""",
}
