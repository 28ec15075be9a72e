"""Task states, durations, trends and alerts over the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniteflow.functions.keys import packed, unpacked
from graniteflow.session import table

#: Event type to task status.
STATUS = {"signup": "pending", "view": "started", "click": "processing", "purchase": "success", "error": "failure"}
STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"


def status() -> Column:
    found = F.lit(None).cast("string")
    for kind, value in STATUS.items():
        found = F.when(F.col("event_type") == kind, value).otherwise(found)
    return found


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("status", status())


def task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


#: Accuracy of the sketch that brackets the median: its ranks are wrong by one part in so many at most.
ACCURACY = 10_000


def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each status the value at position n div 2 of the sorted values.

    A quantile sketch, which combines before the shuffle, gives two values with the median between them, whatever the
    values' spread. Counts of equal values are summed up below, between and above these; only the part that holds the
    position is sorted, four parts in ACCURACY of the rows. Were the sketch wrong, another part would be sorted: the result is exact.
    """
    rows = events(spark, sf_dir).where("value IS NOT NULL")
    near = F.percentile_approx("value", [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY], ACCURACY)
    limits = rows.groupBy("status").agg(near.alias("near"), F.count("*").alias("n"))  # a row for each status
    counts = rows.groupBy("status", "value").agg(F.count("*").alias("k"))
    part = (F.col("value") >= F.col("near")[0]).cast("int") + (F.col("value") > F.col("near")[1]).cast("int")
    dealt = counts.join(F.broadcast(limits), "status").withColumn("part", part)
    sums = dealt.groupBy("status", "part").agg(F.sum("k").alias("held"), F.max("n").alias("n"))  # three rows for each status at most
    upto = F.sum("held").over(Window.partitionBy("status").orderBy("part"))
    found = sums.withColumn("before", upto - F.col("held")).where("before <= n div 2 AND before + held > n div 2").select("status", "part", "before")
    run = F.sum("k").over(Window.partitionBy("status").orderBy("value")) + F.col("before")
    return dealt.join(F.broadcast(found), ["status", "part"]).select("status", "value", "n", run.alias("upto")).where("upto > n div 2").groupBy("status").agg(F.min("value").alias("median"))


def hourly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUS.values()]
    return events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("total"), *counts)


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status of each user by (ts, event_id): one packed number, whose maximum combines before the shuffle."""
    names = list(STATUS.values())
    code = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("status")), F.lit(0))
    key = packed((F.unix_micros(F.col("ts").cast("timestamp")), 17), (F.col("event_id"), 12), (code, 1))
    last = events(spark, sf_dir).groupBy("user_id").agg(F.max(key).alias("_k"), F.count("*").alias("n"))
    micros, _, code = unpacked(F.col("_k"), 17, 12, 1)
    ts = F.timestamp_micros(micros)
    ts = ts.cast("timestamp_ntz") if dict(events(spark, sf_dir).dtypes)["ts"] == "timestamp_ntz" else ts
    return last.select("user_id", F.get(F.array(*map(F.lit, names)), (code - 1).cast("int")).alias("status"), ts.alias("ts"), "n")


def user_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten users with most errors; a top-k report."""
    return events(spark, sf_dir).where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of a user's values from one event to the next; the first has 0."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).select("event_id", "user_id", F.round(F.col("value") - F.lag("value", 1).over(order), 2).alias("_d")).select("event_id", "user_id", F.coalesce("_d", F.lit(0.0)).alias("delta"))


def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most tasks of a user open at once: views open, purchases and errors close."""
    step = F.when(F.col("status") == "started", 1).when(F.col("status").isin("success", "failure"), -1).otherwise(0)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf_dir).select("user_id", F.sum(step).over(order).alias("open")).groupBy("user_id").agg(F.max("open").alias("peak"))


def error_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with one key in one hour are one row, with count, first and last time."""
    key = F.get_json_object("props", "$.k").cast("int").alias("k")
    rows = events(spark, sf_dir).where("event_type = 'error'").select(F.date_trunc("hour", "ts").alias("hour"), key, "ts")
    return rows.groupBy("hour", "k").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed tasks stand at 0, done ones at 100, others by their key up to 95; with a bucket of their value."""
    done = F.when(F.col("status") == "failure", 0).when(F.col("status") == "success", 100)
    done = done.otherwise(F.least(F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(10)), F.lit(95)))
    bucket = F.when(F.col("value") > 80, "high").when(F.col("value") > 50, "medium").otherwise("low")
    return events(spark, sf_dir).select("event_id", done.alias("progress"), bucket.alias("bucket"))


QUERIES = {f.__name__: f for f in (task_stats, upper_median, hourly_trend, latest_state, user_stats, top_errors, counter_deltas, peak_concurrency, error_signatures, progress)}
_E = f"e AS (SELECT *, {STATUS_SQL} AS status FROM events)"
ORACLES = {
    "task_stats": f"WITH {_E} SELECT status, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM e GROUP BY 1",
    "upper_median": f"WITH {_E} SELECT status, list_sort(list(value))[(count(*) // 2 + 1)::INT] AS median FROM e WHERE value IS NOT NULL GROUP BY 1",
    "hourly_trend": f"WITH {_E} SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUS.values()) + " FROM e GROUP BY 1",
    "latest_state": f"WITH {_E} SELECT user_id, status, ts, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM e) WHERE r = 1",
    "user_stats": "SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "top_errors": "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "counter_deltas": "SELECT event_id, user_id, coalesce(round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2), 0.0) AS delta FROM events",
    "peak_concurrency": f"WITH {_E} SELECT user_id, max(o)::BIGINT AS peak FROM (SELECT user_id, sum(CASE status WHEN 'started' THEN 1 WHEN 'success' THEN -1 WHEN 'failure' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS o FROM e) GROUP BY 1",
    "error_signatures": "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, json_extract_string(props, '$.k')::INT AS k, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE event_type = 'error' GROUP BY ALL",
    "progress": f"WITH {_E} SELECT event_id, CASE status WHEN 'failure' THEN 0 WHEN 'success' THEN 100 ELSE least(coalesce(json_extract_string(props, '$.k')::INT, 10), 95) END::INT AS progress, CASE WHEN value > 80 THEN 'high' WHEN value > 50 THEN 'medium' ELSE 'low' END AS bucket FROM e",
}
