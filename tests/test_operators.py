"""Greedy selection against a plain loop, streams against tables, files and texts."""

from pyspark.sql import functions as F

from graniteflow.functions.text import metres, text_type
from graniteflow.operators.greedy import greedy_selection
from graniteflow.plans.content import greedy_boxes
from graniteflow.plans.layout import boxes
from graniteflow.sources.files import export, export_all, report_lines, scan
from graniteflow.streaming.alerts import alerts
from graniteflow.streaming.tasks import advanced, first_errors, task_states

SF = "/root/testdata/sf0.001"


def test_greedy_boxes_against_a_loop(spark):
    found = {r["id"]: r["kept"] for r in greedy_boxes(spark, SF).collect()}
    rows = sorted(boxes(spark, SF).collect(), key=lambda r: r["id"])
    kept, want, seen = [], {}, set()
    for b in rows:
        key = (b["grp"], b["x1"], b["y1"], b["x2"], b["y2"])
        if key in seen:
            continue
        seen.add(key)
        bad = False
        for k in kept:
            w = max(0, min(b["x2"], k["x2"]) - max(b["x1"], k["x1"])) * max(0, min(b["y2"], k["y2"]) - max(b["y1"], k["y1"]))
            area = sum((r["x2"] - r["x1"]) * (r["y2"] - r["y1"]) for r in (b, k))
            bad |= k["grp"] == b["grp"] and w > 0.05 * (area - w)
        want[b["id"]] = not bad
        if not bad:
            kept.append(b)
    assert found == want


def test_greedy_chain_and_empty(spark):
    nodes = spark.range(6).toDF("id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "low long, high long")
    assert {r["id"]: r["kept"] for r in greedy_selection(nodes, edges).collect()} == {0: True, 1: False, 2: True, 3: False, 4: True, 5: True}
    assert greedy_selection(nodes.limit(0), edges.limit(0)).collect() == []


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = alerts(stream, late="9999 days").writeStream.format("memory").queryName("alerts").outputMode("complete")
    query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(spark.table("alerts").collect()) == sorted(alerts(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect())


def test_files(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7", "b.PDF": b"text", "c.png": b"", "d.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    found = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["errors"]) for r in scan(spark, str(tmp_path)).collect()}
    assert found == {"a.pdf": ("pdf", []), "b.PDF": ("pdf", ["not a PDF"]), "c.png": ("image", ["empty file"]), "d.txt": ("unsupported", ["unsupported type"])}
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n int, kind string")
    export(rows, str(tmp_path / "marked"), "csv", mark=True)
    assert {p.read_bytes()[:5] for p in (tmp_path / "marked").glob("*.csv")} == {b"\xef\xbb\xbfn,"}
    done = export_all(rows, str(tmp_path / "all"), ["json", "pdf"])
    assert [(d["form"], d["error"]) for d in done] == [("json", None), ("pdf", "unknown form: pdf")]
    assert sorted(r["value"] for r in report_lines(rows, "Rows").collect()) == ["# Rows", "n: 1; kind: a", "n: 2; kind: b"]
    for form in ("json", "csv", "parquet"):
        export(rows, str(tmp_path / form), form, by="kind")
        assert spark.read.option("header", "true").format(form).load(str(tmp_path / form)).count() == 2


def test_texts(spark):
    rows = spark.createDataFrame([("KZ-1",), ("200×300",), ("2.5",), ("200mm",), ("cold widget",), ("?",), (None,)], "t string")
    out = rows.select(text_type(F.col("t")), metres(F.col("t"))).collect()
    assert [r[0] for r in out] == ["component_id", "dimension", "number", "unknown", "label", "unknown", None]
    assert [out[2][1], out[3][1], out[5][1], out[6][1]] == [2.5, 0.2, None, None]


def run_stream(spark, tmp_path, batches, schema, transform, name):
    """The rows that a stream gives for each batch of rows in turn, one file a batch."""
    source = tmp_path / f"{name}-in"
    source.mkdir()
    out = []
    stream = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    keep = lambda df, n: out.extend((n, *r) for r in df.collect())
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = stream.writeStream.outputMode("update" if name == "states" else "append").option("checkpointLocation", str(tmp_path / f"{name}-state"))
        query.foreachBatch(lambda df, _, n=n: keep(df, n)).trigger(availableNow=True).start().awaitTermination()
    return out


def at(minute):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_task_states(spark, tmp_path):
    schema = "task string, ts timestamp, status string, progress int"
    batches = [
        [("a", at(0), "started", 10), ("a", at(5), "processing", 130), ("b", at(1), "started", None), (None, at(1), "started", 1)],
        [("a", at(3), "processing", 20), ("b", at(2), "success", None), ("b", at(4), "failure", 0)],
        [("c", at(400), "started", 1)],
        [("a", at(6), "success", None)],  # far behind the watermark: dropped
        [("c", at(900), "success", None)],
    ]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = run_stream(spark, tmp_path, batches, schema, task_states, "states")
    last = {}
    for n, task, status, progress, began, ended, seen, updates, reason in out:
        last.setdefault(task, []).append((n, status, progress, updates, reason))
    assert last["a"][:2] == [(0, "processing", 100, 2, None), (1, "processing", 100, 3, None)]
    assert last["b"][0][1:4] == ("started", 0, 1) and last["b"][1][1:4] == ("success", 100, 3)
    assert last["a"][2][1] == "failure" and last["a"][2][4] == "stale" and len(last["a"]) == 3
    assert last["c"][-1][1] == "success"


def test_states_do_not_go_back():
    state = None
    for ts, status, progress in [(10, "started", 5), (20, "processing", -3), (15, "failure", 1), (30, "success", None), (40, "started", 7)]:
        state = advanced(state, ts, status, progress)
    assert state == ("success", 100, 10, 30, 40, 5)


def test_first_errors(spark, tmp_path):
    schema = "event_type string, props string, ts timestamp, user_id long"
    error = lambda k, minute, user: ("error", f'{{"k":{k}}}', at(minute), user)
    batches = [[error(1, 0, 1), error(1, 1, 2), ("view", "{}", at(0), 3)], [error(1, 10, 4), error(2, 11, 5)], [error(3, 500, 6)], [error(3, 20, 7)]]
    out = run_stream(spark, tmp_path, batches, schema, first_errors, "errors")
    assert len(out) == 3 and {r[0] for r in out} == {0, 1, 2}


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "event_type string, ts timestamp"
    errors = lambda *minutes: [("error", at(m)) for m in minutes]
    batches = [errors(5, 6, 7), errors(600), errors(8)]  # the last one is behind the watermark of two hours
    out = run_stream(spark, tmp_path, batches, schema, lambda s: alerts(s, least=3), "late")
    assert {r[2] for r in out} == {3}
