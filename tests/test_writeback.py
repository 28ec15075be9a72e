"""Write-back: batches that run again, partitions that stay, patches of single columns; and fusion of attributes."""

import os
from pathlib import Path

from graniteflow.plans.fusion import ATTRIBUTES, fused_maps, quantities_and_sources
from graniteflow.sources.writeback import BATCH, PART, read_table, upserted, write_back, writer

SCHEMA = "id long, status string, note string, ts long"


def files(path):
    return {str(p.relative_to(path)): os.stat(p).st_mtime_ns for p in Path(path).rglob("*.parquet")}


def held(spark, path):
    return {r["id"]: (r["status"], r["note"]) for r in read_table(spark, path).collect()}


def test_batches_patch_and_run_again(spark, tmp_path):
    path = str(tmp_path / "table")
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert read_table(spark, path) is None and write_back(make([]), 0, path, ["id"], "ts") == []
    first = make([(i, "new", None, 1) for i in range(40)] + [(3, "newer", None, 2), (3, None, "kept", 0), (None, "no key", None, 1)])
    assert len(write_back(first, 1, path, ["id"], "ts", 8)) == 8
    assert held(spark, path)[3] == ("newer", "kept") and held(spark, path)[4] == ("new", None) and len(held(spark, path)) == 40
    before = files(path)
    assert write_back(first, 1, path, ["id"], "ts", 8) == [] and files(path) == before  # the same batch changes nothing
    patch = make([(5, None, "seen", 9), (100, "added", None, 9)])
    done = write_back(patch, 2, path, ["id"], "ts", 8)
    assert held(spark, path)[5] == ("new", "seen") and held(spark, path)[100] == ("added", None) and len(held(spark, path)) == 41
    after = files(path)
    assert len(done) <= 2 and {f for f in before if f in after} == {f for f in before if int(f.split("/")[0].split("=")[1]) not in done}
    assert all(after[f] == before[f] for f in before if f in after)
    assert {r[PART] for r in read_table(spark, path).where(f"{BATCH} = 2").select(PART).collect()} == set(done)


def test_batch_that_failed_halfway_is_completed(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(i, "a", None, 1) for i in range(30)], SCHEMA)
    write_back(rows, 1, path, ["id"], "ts", 4)
    change = rows.selectExpr("id", "'b' AS status", "note", "ts")
    # as if only some partitions had been replaced
    from graniteflow.sources.writeback import part_of

    write_back(change.where(part_of(["id"], 4) < 2), 2, path, ["id"], "ts", 4)
    half = files(path)
    assert sorted(write_back(change, 2, path, ["id"], "ts", 4)) == [2, 3]
    assert set(s for s, _ in held(spark, path).values()) == {"b"} and all(files(path).get(f) == t for f, t in half.items() if f[6] in "01")


def test_stream_writes_back_and_restarts(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "table")
    for n in range(2):
        spark.createDataFrame([(i, f"s{n}", None if n else "first", n) for i in range(n * 5, 12)], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(writer(path, ["id"], "ts", 4)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert held(spark, path) == {i: ("s0" if i < 5 else "s1", "first") for i in range(12)}


def test_upserted_keeps_other_columns_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, None, None)], "k int, v string, w int")
    changes = spark.createDataFrame([(1, None, 1), (2, "x", 1), (2, "y", 1), (3, "z", None), (None, "q", 1)], "k int, v string, at int")
    assert sorted(tuple(r) for r in upserted(rows, changes, ["k"], "at").collect()) == [(1, "a", 5), (2, "y", None), (3, "z", None)]
    assert sorted(tuple(r) for r in upserted(rows, changes.limit(0), ["k"], "at").collect()) == [(1, "a", 5), (2, None, None)]


def test_attributes_fill_and_the_longest_text_wins(spark):
    # two tiles: the second sighting of a column fills what the first lacks
    rows = [
        ("KZ-1", 1, {"width": "0.5", "height": "", "length": None}, "C30", None), ("L-1", 2, {"width": "0.3"}, "", "b"), ("KZ-1", 3, {"width": "0.9", "height": "0.6", "length": "3.6"}, "C30 concrete", "x"),
        ("KZ-1", 4, None, "HRB400 steel", "y"), (None, 5, {}, None, None), (None, 6, {"a": "1"}, "t", None),
    ]
    table = spark.createDataFrame(rows, "code string, ord long, dimensions map<string,string>, material string, notes string")
    found = {r["code"]: r for r in fused_maps(table, ["code"], "ord", {"dimensions": "map", "material": "text", "notes": "text"}).collect()}
    assert found["KZ-1"]["dimensions"] == {"width": "0.5", "height": "0.6", "length": "3.6"} and found["KZ-1"]["material"] == "C30 concrete" and found["KZ-1"]["notes"] == "x"
    assert found["L-1"]["dimensions"] == {"width": "0.3"} and found["L-1"]["material"] is None and found[None]["dimensions"] == {"a": "1"} and found[None]["n"] == 2
    assert len(ATTRIBUTES) == 7 and fused_maps(table.limit(0), ["code"], "ord", {"dimensions": "map"}).count() == 0


def test_two_tiles_of_columns(spark):
    """Two tiles, at (0,0) and (0,300): the column seen twice counts twice and keeps its first place and both sources."""
    rows = [("KZ-1", 1, 1, "tile 0"), ("L-1", 2, 1, "tile 1"), ("KZ-1", 3, None, "tile 1"), ("KZ-1", 4, 2, "tile 1"), ("L-1", 5, 1, None)]
    table = spark.createDataFrame(rows, "code string, ord long, quantity long, source string")
    found = {r["code"]: (r["quantity"], r["sources"]) for r in quantities_and_sources(table, ["code"], "ord").collect()}
    assert found == {"KZ-1": (4, ["tile 0", "tile 1"]), "L-1": (2, ["tile 1"])}
