"""The curve's order, look-ups by box in it, and joins with boxes against plain loops."""

import random

from pyspark.sql import functions as F

from graniteflow.operators.places import MOST, in_box, place, points_in_boxes, ranges, write_in_order

POINT, BOX = "grp string, id long, x double, y double", "grp string, id long, x1 double, y1 double, x2 double, y2 double"


def number(x, y):
    return int("".join(b + a for a, b in zip(f"{x:024b}", f"{y:024b}", strict=True)), 2)


def test_place_takes_bits_in_turn(spark):
    draw = random.Random(1)
    points = [(0, 0), (1, 0), (0, 1), (MOST, MOST), *[(draw.randrange(MOST), draw.randrange(MOST)) for _ in range(50)]]
    rows = spark.createDataFrame(points, "x long, y long").select("x", "y", place(F.col("x"), F.col("y")).alias("p")).collect()
    assert all(r.p == number(r.x, r.y) for r in rows)
    odd = spark.createDataFrame([(-5.0, 2.7), (float("nan"), 0.0), (float("inf"), 1.0), (None, 1.0)], "x double, y double").select(place(F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in odd] == [number(0, 2), number(MOST, 0), number(MOST, 1), None]


def test_ranges_hold_the_box():
    draw = random.Random(2)
    for most in (8, 48, 400):
        for _ in range(30):
            x, y = draw.randrange(300), draw.randrange(300)
            box = (x, y, x + draw.randrange(40), y + draw.randrange(40))
            found = ranges(box, most)
            assert len(found) <= most and all(a <= b < c for (a, b), (c, _) in zip(found, found[1:], strict=False))
            inside = {number(i, j) for i in range(box[0], box[2] + 1) for j in range(box[1], box[3] + 1)}
            assert all(any(low <= n <= high for low, high in found) for n in inside)
            if most == 400:  # enough ranges for the box and nothing else
                assert sum(high - low + 1 for low, high in found) == len(inside)
    assert ranges((5, 5, 4, 9)) == [] and ranges((-9, -9, MOST * 2, MOST * 2)) == [(0, 4**24 - 1)]


def test_look_up_reads_few_rows(spark, tmp_path):
    draw = random.Random(3)
    points = [("a", i, draw.uniform(-50, 4000), draw.uniform(-50, 4000)) for i in range(20_000)]
    points += [("a", 20_000 + i, 700.0, 700.0) for i in range(9_000)] + [("a", 29_000, None, 3.0), ("b", 29_001, 0.5, None)]
    folder = str(tmp_path / "t")
    write_in_order(spark.createDataFrame(points, POINT), folder, files=16)
    box = (1000.5, 2000.0, 1250.0, 2300.25)
    found = in_box(spark.read.parquet(folder), box)
    assert sorted(r.id for r in found.collect()) == [i for _, i, x, y in points if x is not None and y is not None and box[0] <= x <= box[2] and box[1] <= y <= box[3]]
    plan = found._jdf.queryExecution().executedPlan()
    assert "GreaterThanOrEqual(place" in plan.toString()
    read = plan.collectLeaves().apply(0).metrics().get("numOutputRows").get().value()
    assert read < len(points) / 4, read
    sizes = [spark.read.parquet(f).count() for f in spark.read.parquet(folder).inputFiles()]
    assert max(sizes) < 3 * len(points) / 16  # rows of one point are spread
    assert in_box(spark.read.parquet(folder), (-60.0, -60.0, 0.0, 0.0)).count() == sum(x is not None and y is not None and x <= 0 and y <= 0 for _, _, x, y in points)
    assert in_box(spark.read.parquet(folder), (9.0, 9.0, 8.0, 10.0)).count() == 0


def test_points_in_boxes_against_loops(spark):
    draw = random.Random(4)
    points = [(draw.choice("ab"), i, float(draw.randrange(400)), draw.uniform(-20, 400)) for i in range(600)] + [(None, 900, 1.0, 1.0), ("a", 901, None, 1.0), ("a", 902, 1e9, 5.0)]
    boxes = []
    for i in range(60):
        x, y, side = draw.uniform(-30, 380), draw.uniform(-30, 380), draw.choice([0, 3, 40, 300])
        boxes.append((draw.choice("ab"), i, x, y, x + side, y + draw.uniform(0, side)))
    boxes += [("a", 70, 5.0, 5.0, 4.0, 9.0), ("a", 71, 1e8, 0.0, 1e9, 9.0), (None, 72, 0.0, 0.0, 9.0, 9.0), ("b", 73, None, 0.0, 9.0, 9.0), boxes[0]]
    found = points_in_boxes(spark.createDataFrame(points, POINT).withColumn("note", F.lit("p")), spark.createDataFrame(boxes, BOX).withColumn("note", F.lit("b")))
    want = sorted((i, j) for g, i, x, y in points if g and x is not None for h, j, x1, y1, x2, y2 in boxes if g == h and x1 is not None and x1 <= x <= x2 and y1 <= y <= y2)
    assert sorted((r.id, r.id_) for r in found.collect()) == want and len(want) > 300
    assert found.columns == ["grp", "id", "x", "y", "note", "id_", "x1_", "y1_", "x2_", "y2_", "note_"]
    none = spark.createDataFrame([], BOX)
    assert points_in_boxes(spark.createDataFrame(points, POINT), none).count() == 0
