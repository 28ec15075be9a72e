"""Monitoring of tasks, errors and connections: rates, levels, series, staleness, alerts and retention, at a fixed time of report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.plans.events import STATUS_SQL, events
from graniteflow.functions.keys import packed
from graniteflow.session import table

#: The time of report, given in so that results don't depend on the clock, and hours that a window looks back.
NOW, HOURS = "2024-01-20 00:00:00", 240
#: Thresholds of the two alerts on a metric, seconds after which a task is stale, timed out or no longer fresh.
LIMITS = (80, 85)
STALE, TIMEOUT, FRESH = 2 * 3600, 30 * 60, 5 * 60
CATEGORIES = ["network", "parsing", "storage"]


def now() -> Column:
    return F.to_timestamp(F.lit(NOW)).cast("timestamp")


def key() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time as a timestamp, key, and category and level of what would be an error."""
    category = F.get(F.array(*map(F.lit, CATEGORIES)), F.pmod(F.col("k"), F.lit(3)))
    level = F.when(F.col("value") > 90, "critical").when(F.col("value") > 50, "error").otherwise("warning")
    return events(spark, sf_dir).withColumns({"ts": F.col("ts").cast("timestamp"), "k": key()}).withColumns({"category": category, "level": level})


def windowed_task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of the last hours: counts by status, shares of successes and errors, mean value, throughput an hour."""
    rows = stamped(spark, sf_dir).where(F.col("ts") >= now() - F.expr(f"INTERVAL {HOURS} HOURS"))
    done = F.count_if(F.col("status").isin("success", "failure"))
    share = lambda s: F.round(F.coalesce(F.try_divide(F.count_if(F.col("status") == s) * 100, done), F.lit(0.0)), 4)
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "started").alias("running"), F.count_if(F.col("status") == "success").alias("completed"),
        F.count_if(F.col("status") == "failure").alias("failed"), share("success").alias("success_rate"), share("failure").alias("error_rate"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("mean"),
        F.round(F.count("*") / HOURS, 4).alias("throughput"),
    )


def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by category, by level and in all, in one pass."""
    rows = stamped(spark, sf_dir).where("event_type = 'error'")
    return rows.groupingSets([["category"], ["level"], []], "category", "level").agg(F.count("*").alias("n"), F.count_distinct("k").alias("kinds"), F.max("ts").alias("last_ts"))


def error_statistics(spark: SparkSession, sf_dir: str, most: int = 10) -> DataFrame:
    """Errors of the window: their number, that of each kind, and the messages that are most frequent, ``most`` of them; that limit is the feature.

    One aggregate by kind and message, before anything is sorted; ties go to the message that came first, by time and id.
    """
    rows = stamped(spark, sf_dir).where("event_type = 'error'").where(F.col("ts") >= now() - F.expr(f"INTERVAL {HOURS} HOURS"))
    message = F.when(F.col("k") % 10 != 0, F.concat_ws(" ", "category", "level", F.col("k") % 17))
    first = packed((F.unix_micros("ts"), 17), (F.col("event_id"), 13))
    held = rows.groupBy(F.coalesce("category", F.lit("unknown")).alias("name"), message.alias("message")).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    kinds = held.rollup("name").agg(F.sum("n").alias("n")).select(F.when(F.col("name").isNull(), "total").otherwise("kind").alias("part"), "name", "n")
    top = held.where("message IS NOT NULL").groupBy("message").agg(F.sum("n").alias("n"), F.min("first").alias("first")).orderBy(F.desc("n"), "first").limit(most)
    return kinds.union(top.select(F.lit("message").alias("part"), F.col("message").alias("name"), "n"))


def error_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty critical errors of one category within the window; the limit is the feature."""
    rows = stamped(spark, sf_dir).where("event_type = 'error'").where((F.col("category") == "parsing") & (F.col("level") != "warning") & (F.col("ts") >= now() - F.expr(f"INTERVAL {HOURS} HOURS")))
    return rows.orderBy("ts", "event_id").limit(50).select("event_id", "ts", "level")


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of every hour of the last days, hours without any too."""
    hours = spark.range(HOURS).select((F.date_trunc("hour", now()) - F.make_dt_interval(hours=F.col("id").cast("int") + 1)).alias("hour"))
    counts = stamped(spark, sf_dir).where("event_type = 'error'").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(counts, "hour", "left").select(F.date_format("hour", "yyyy-MM-dd HH:00").alias("hour"), F.coalesce("n", F.lit(0)).alias("n"))


def metric_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None, one or two alerts for each event taken as a sample of two metrics."""
    cpu, memory = F.col("value"), F.col("k") % 100
    alert = lambda test, name, value: F.when(test, F.struct(F.lit(name).alias("metric"), value.cast("double").alias("reading")))
    rows = stamped(spark, sf_dir).select("event_id", F.inline(F.array_compact(F.array(alert(cpu > LIMITS[0], "cpu", cpu), alert(memory > LIMITS[1], "memory", memory)))))
    return rows.groupBy("metric").agg(F.count("*").alias("n"), F.max("reading").alias("most"))


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event type mean, extremes and the latest reading, the latest by time, then id."""
    latest = F.max_by("value", packed((F.unix_micros("ts"), 17), (F.col("event_id"), 18)))
    sums = [F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), latest.alias("latest")]
    return stamped(spark, sf_dir).groupBy("event_type").agg(*sums)


def task_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's task: first start, last end, seconds between (to the report while it isn't over), state and what is to be done.

    A task is stale two hours after it began without an end; a timed-out one is to fail, a fresh one is left alone.
    """
    rows = stamped(spark, sf_dir).groupBy("user_id").agg(
        F.min(F.when(F.col("status") == "started", F.col("ts"))).alias("began"), F.max(F.when(F.col("status").isin("success", "failure"), F.col("ts"))).alias("ended"), F.max("ts").alias("seen"),
        F.count_if(F.col("status") == "failure").alias("failures"),
    )
    seconds = (F.unix_seconds(F.coalesce(F.when(F.col("ended") >= F.col("began"), F.col("ended")), now())) - F.unix_seconds("began")).alias("seconds")
    idle = F.unix_seconds(now()) - F.unix_seconds("seen")
    action = F.when(idle > TIMEOUT, "fail").when(idle < FRESH, "ok").otherwise("restart")
    return rows.select("user_id", seconds, (idle > STALE).alias("stale"), action.alias("action"), F.least(F.lit(100), F.greatest(F.lit(0), 100 - F.col("failures") * 5)).alias("progress"))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a retention of ten days keeps, finished ones of a day alone, by status."""
    age = F.unix_seconds(now()) - F.unix_seconds("ts")
    keep = F.when(F.col("status").isin("success", "failure"), age <= 86_400).otherwise(age <= 10 * 86_400)
    return stamped(spark, sf_dir).groupBy("status").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def connection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as connections: healthy within a day of the report, others inactive, with their endpoints."""
    seen = stamped(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("seen"), F.count_distinct("event_type").alias("endpoints"))
    healthy = F.unix_seconds(now()) - F.unix_seconds("seen") <= 86_400
    return seen.agg(F.count("*").alias("connections"), F.count_if(healthy).alias("healthy"), F.count_if(~healthy).alias("inactive"), F.max("endpoints").alias("most_endpoints"))


def known_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of whichever of three scores a user has; null without any."""
    score = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    rows = stamped(spark, sf_dir).groupBy("user_id").agg(score("purchase").alias("a"), score("signup").alias("b"), score("error").alias("c"))
    held = F.array_compact(F.array("a", "b", "c"))
    return rows.select("user_id", F.round(F.try_divide(F.aggregate(held, F.lit(0.0), lambda s, x: s + x), F.size(held)), 4).alias("score"), F.size(held).alias("known"))


def new_error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which five and more kinds of errors were seen first."""
    first = stamped(spark, sf_dir).where("event_type = 'error'").groupBy(F.md5(F.concat_ws("|", "event_type", "k", "category")).alias("signature")).agg(F.min("ts").alias("first"))
    return first.groupBy(F.to_date("first").alias("day")).agg(F.count("*").alias("n")).where("n >= 5").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def routed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors routed to owners: by the user of the event, or the customer of its key where the user is no customer."""
    rows = stamped(spark, sf_dir).where("event_type = 'error'").select("event_id", "user_id", "k")
    owners = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    a = owners.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("direct"))
    b = owners.select(F.col("c_custkey").cast("int").alias("k"), F.col("c_nationkey").alias("by_key"))
    return rows.join(a, "user_id", "left").join(b, "k", "left").groupBy(F.coalesce("direct", "by_key", F.lit(-1)).alias("nation")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        windowed_task_stats, error_summary, error_statistics, error_search, hourly_series, metric_alerts, metric_summary, task_life, retention, connection_stats, known_scores, new_error_kinds, routed_updates,
    )
}
_S = f"""s AS (SELECT *, {STATUS_SQL} AS status, json_extract_string(props, '$.k')::INT AS k, ['network', 'parsing', 'storage'][json_extract_string(props, '$.k')::INT % 3 + 1] AS category,
    CASE WHEN value > 90 THEN 'critical' WHEN value > 50 THEN 'error' ELSE 'warning' END AS level, epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(ts))::BIGINT AS age FROM events)"""
_SINCE = f"ts >= TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR"
ORACLES = {
    "windowed_task_stats": f"""WITH {_S} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'started') AS running, count(*) FILTER (status = 'success') AS completed, count(*) FILTER (status = 'failure') AS failed,
      round(coalesce(count(*) FILTER (status = 'success') * 100 / nullif(count(*) FILTER (status IN ('success', 'failure')), 0), 0.0), 4) AS success_rate, round(coalesce(count(*) FILTER (status = 'failure') * 100 / nullif(count(*) FILTER (status IN ('success', 'failure')), 0), 0.0), 4) AS error_rate,
      round(coalesce(avg(value), 0.0), 4) AS mean, round(count(*) / {HOURS}, 4) AS throughput FROM s WHERE {_SINCE}""",
    "error_summary": f"WITH {_S} SELECT category, level, count(*) AS n, count(DISTINCT k) AS kinds, max(ts) AS last_ts FROM s WHERE event_type = 'error' GROUP BY GROUPING SETS ((category), (level), ())",
    "error_statistics": f"""WITH {_S}, e AS (SELECT *, CASE WHEN k % 10 != 0 THEN concat_ws(' ', category, level, k % 17) END AS message FROM s WHERE event_type = 'error' AND {_SINCE})
      SELECT CASE WHEN category IS NULL THEN 'total' ELSE 'kind' END AS part, category AS name, count(*) AS n FROM e GROUP BY ROLLUP (category)
      UNION ALL (SELECT 'message', message, count(*) AS n FROM e WHERE message IS NOT NULL GROUP BY message ORDER BY n DESC, min(ts), min(event_id) LIMIT 10)""",
    "error_search": f"WITH {_S} SELECT event_id, ts, level FROM s WHERE event_type = 'error' AND category = 'parsing' AND level != 'warning' AND {_SINCE} ORDER BY ts, event_id LIMIT 50",
    "hourly_series": f"""WITH h AS (SELECT date_trunc('hour', TIMESTAMP '{NOW}') - to_hours(i + 1) AS hour FROM range({HOURS}) r(i)), c AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
      SELECT strftime(hour, '%Y-%m-%d %H:00') AS hour, coalesce(n, 0) AS n FROM h LEFT JOIN c USING (hour)""",
    "metric_alerts": f"""WITH {_S} SELECT metric, count(*) AS n, max(reading) AS most FROM (SELECT 'cpu' AS metric, value AS reading FROM s WHERE value > 80 UNION ALL SELECT 'memory', (k % 100)::DOUBLE FROM s WHERE k % 100 > 85) GROUP BY 1""",
    "metric_summary": f"WITH {_S} SELECT event_type, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, arg_max(value, (ts, event_id)) AS latest FROM s GROUP BY 1",
    "task_life": f"""WITH {_S}, u AS (SELECT user_id, min(ts) FILTER (status = 'started') AS began, max(ts) FILTER (status IN ('success', 'failure')) AS ended, min(age) AS idle, count(*) FILTER (status = 'failure') AS failures FROM s GROUP BY 1)
      SELECT user_id, floor(epoch(CASE WHEN ended >= began THEN ended ELSE TIMESTAMP '{NOW}' END))::BIGINT - floor(epoch(began))::BIGINT AS seconds, idle > {STALE} AS stale, CASE WHEN idle > {TIMEOUT} THEN 'fail' WHEN idle < {FRESH} THEN 'ok' ELSE 'restart' END AS action,
        least(100, greatest(0, 100 - failures * 5)) AS progress FROM u""",
    "retention": f"""WITH {_S}, k AS (SELECT status, CASE WHEN status IN ('success', 'failure') THEN age <= 86400 ELSE age <= 864000 END AS keep FROM s) SELECT status, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped FROM k GROUP BY 1""",
    "connection_stats": f"""WITH {_S}, u AS (SELECT user_id, min(age) AS idle, count(DISTINCT event_type) AS endpoints FROM s GROUP BY 1)
      SELECT count(*) AS connections, count(*) FILTER (idle <= 86400) AS healthy, count(*) FILTER (idle > 86400) AS inactive, max(endpoints) AS most_endpoints FROM u""",
    "known_scores": """WITH u AS (SELECT user_id, [avg(value) FILTER (event_type = 'purchase'), avg(value) FILTER (event_type = 'signup'), avg(value) FILTER (event_type = 'error')] AS v FROM events GROUP BY 1),
      h AS (SELECT user_id, list_filter(v, lambda x: x IS NOT NULL) AS h FROM u) SELECT user_id, CASE WHEN len(h) > 0 THEN round(list_sum(h) / len(h), 4) END AS score, len(h)::INT AS known FROM h""",
    "new_error_kinds": f"""WITH {_S}, f AS (SELECT k, category, min(ts) AS first FROM s WHERE event_type = 'error' GROUP BY ALL) SELECT strftime(first, '%Y-%m-%d') AS day, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 5""",
    "routed_updates": f"""WITH {_S} SELECT coalesce(a.c_nationkey, b.c_nationkey, -1) AS nation, count(*) AS n FROM s LEFT JOIN customer a ON a.c_custkey = user_id LEFT JOIN customer b ON b.c_custkey = k WHERE event_type = 'error' GROUP BY 1""",
}
