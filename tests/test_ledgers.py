"""Ledgers over streams against their twins on tables; late rows, closing, restarts and lapsing state."""

import datetime
import time

import pytest
from graniteflow.streaming.ledgers import error_records, error_records_of_table, joined_spells, task_history, task_history_of_table, task_registry, trimmed


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def run(spark, tmp_path, schema, batches, transform):
    """What the stream gives for each batch; the query stops after each and starts again from its checkpoint."""
    source, out = tmp_path / "in", []
    source.mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = transform(spark.readStream.schema(schema).parquet(str(source)))
        writer = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        writer.foreachBatch(lambda df, _, n=n: out.extend((n, *r) for r in df.collect())).trigger(availableNow=True).start().awaitTermination(120)
    return out


EVENTS = "event_type string, props string, ts timestamp"


def error(k, hours):
    return ("error", f'{{"k":{k}}}', at(hours))


def test_spells():
    assert joined_spells([(50, 60, 2), (0, 1, 1), (5, 5, 1), (30, 52, 3)], 10) == [(0, 5, 2), (30, 60, 5)]
    assert trimmed([(5, "a"), (1, "b"), (9, "c"), (5, "d")], 3, 4) == [(5, "a"), (5, "d"), (9, "c")]


def test_repeated_errors_are_one_record(spark, tmp_path):
    batches = [
        [error(1, 0), error(1, 0.5), error(2, 1), ("view", "{}", at(0)), ("error", "{}", None)],
        [error(1, 2), error(1, 7), error(2, 1)],  # 7 is over two hours after 2: another record
        [error(1, 4), error(1, 5.5)],  # late, but within the watermark: joins both
        [error(3, 40)],
        [error(1, 6)],  # behind the watermark: dropped
    ]
    out = run(spark, tmp_path, EVENTS, batches, lambda s: error_records(s, 1, "6 hours"))
    last = {}
    for n, signature, first, seen, count, closed in out:
        last.setdefault(signature, []).append((n, first, seen, count, closed))
    one, two, three = sorted(last.values(), key=lambda x: x[0][1])
    assert (0, at(0), at(0.5), 2, False) in one and (1, at(0), at(2), 3, False) in one and (1, at(7), at(7), 1, False) in one
    assert (2, at(0), at(7), 6, False) in one
    assert [r[1:] for r in one if r[4]] == [(at(0), at(7), 6, True)] and [r[3] for r in two if r[4]] == [2]
    assert [r[1:] for r in three] == [(at(40), at(40), 1, False)]


def test_records_equal_their_twin(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 300").select("event_type", "props", "ts")
    rows = [tuple(r) for r in events.collect()]
    out = run(spark, tmp_path, events.schema, [rows[::2], rows[1::2]], lambda s: error_records(s, 1, "9000 hours"))
    ends = {}
    for _, signature, first, seen, n, closed in out:
        assert not closed
        ends[signature, first] = (seen, n)
    want = {(r["signature"], r["first_seen"]): (r["last_seen"], r["n"]) for r in error_records_of_table(events, 1).collect()}
    assert want and {k: ends.get(k) for k in want} == want
    assert sum(n for _, n in want.values()) == events.where("event_type = 'error'").count()


TASKS = "user long, task string, status string, ts timestamp"


def test_history_is_bounded_and_survives_restarts(spark, tmp_path):
    batches = [[(1, f"t{i:02}", "success", at(i)) for i in range(9)] + [(2, "x", "failure", at(1)), (2, "y", "started", at(2)), (None, "z", "success", at(1))]]
    batches += [[(1, "t09", "revoked", at(9)), (1, "t04b", "success", at(4.5))], [(1, "t30", "success", at(30))], [(3, "far", "success", at(90))], [(3, "end", "success", at(91))]]
    out = run(spark, tmp_path, TASKS, batches, lambda s: task_history(s, 4, 24, "10 hours"))
    of = lambda user: [(r[0], *r[2:4], r[6]) for r in out if r[1] == user]
    assert of(1)[:2] == [(0, 9, 4, ["t05", "t06", "t07", "t08"]), (1, 11, 4, ["t06", "t07", "t08", "t09"])]
    assert of(1)[2] == (2, 12, 4, ["t07", "t08", "t09", "t30"]) and of(1)[3][1:] == (12, 0, [])
    assert of(2)[0] == (0, 1, 1, ["x"])


def test_history_equals_its_twin(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 300")
    tasks = events.selectExpr("user_id AS user", "CAST(event_id AS string) AS task", "CASE WHEN event_id % 3 = 0 THEN 'started' ELSE 'success' END AS status", "CAST(ts AS timestamp) AS ts")
    rows = [tuple(r) for r in tasks.collect()]
    out = run(spark, tmp_path, tasks.schema, [rows[::3], rows[1::3], rows[2::3]], lambda s: task_history(s, 5, 1000, "9000 hours"))
    last = {r[1]: r[1:] for r in out}
    assert {r["user"]: tuple(r) for r in task_history_of_table(tasks, 5, 1000).collect()} == last


@pytest.mark.parametrize("wait", [0, 6])
def test_task_state_lapses(spark, tmp_path, wait):
    schema = "task string, ts timestamp, status string, progress int"
    batches = [[("a", at(0), "started", 10), ("a", at(1), "processing", 130), (None, at(0), "started", 1)], [("a", at(0.5), "processing", 20)]]
    source = tmp_path / "in"
    source.mkdir()
    out = []
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a run would wait for states to lapse
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = task_registry(spark.readStream.schema(schema).parquet(str(source)), "5 seconds" if wait else "1 hour")
        writer = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        assert writer.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).trigger(availableNow=True).start().awaitTermination(60)
        time.sleep(wait)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert out[0] == ("a", "processing", 100, 2)
    assert out[1] == (("a", "processing", 20, 1) if wait else ("a", "processing", 100, 3))
