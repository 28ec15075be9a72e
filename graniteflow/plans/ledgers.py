"""What the streams of ``graniteflow.streaming.ledgers`` end with, on the table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.session import table
from graniteflow.streaming.ledgers import error_records_of_table, task_history_of_table


def _as_given(df: DataFrame, events: DataFrame, *times: str) -> DataFrame:
    """Times without a zone where the table's have none."""
    return df.withColumns({t: F.col(t).cast(dict(events.dtypes)["ts"]) for t in times})


def error_record_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a signature within two hours of one another as one record: first and last time and number."""
    events = table(spark, sf_dir, "events")
    return _as_given(error_records_of_table(events, 1), events, "first_seen", "last_seen")


def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user the newest ten ended tasks within 72 hours of the newest, and how many there were in all."""
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "revoked").otherwise("started")
    events = table(spark, sf_dir, "events")
    tasks = events.select(F.col("user_id").alias("user"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("task"), status.alias("status"), "ts")
    return _as_given(task_history_of_table(tasks, 10, 72).withColumn("tasks", F.concat_ws(",", "tasks")), events, "oldest", "newest")


QUERIES = {f.__name__: f for f in (error_record_list, bounded_history)}
ORACLES = {
    "error_record_list": """WITH e AS (SELECT md5(concat_ws('|', event_type, json_extract_string(props, '$.k'))) AS signature, ts FROM events WHERE event_type = 'error'),
      n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY signature ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM e),
      r AS (SELECT *, sum(new) OVER (PARTITION BY signature ORDER BY ts) AS record FROM n)
      SELECT signature, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM r GROUP BY signature, record""",
    "bounded_history": """WITH e AS (SELECT user_id AS user, lpad(event_id::VARCHAR, 12, '0') AS task, ts FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
      p AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY ts DESC, task DESC) AS place, count(*) OVER (PARTITION BY user) AS total, max(ts) OVER (PARTITION BY user) AS newest FROM e)
      SELECT user, total, count(*) AS held, min(ts) AS oldest, newest, string_agg(task, ',' ORDER BY ts, task) AS tasks FROM p WHERE place <= 10 AND ts >= newest - INTERVAL 72 HOUR GROUP BY ALL""",
}
