"""Lines of texts and medians against plain loops."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from graniteflow.plans.events import upper_median
from graniteflow.plans.regions import lines_of


def test_lines_against_a_loop(spark):
    draw = random.Random(5)
    rows = []
    for i in range(500):
        x, y = draw.randrange(0, 300), draw.randrange(0, 260)
        rows.append((draw.randrange(3), i, f"t{i}", x, y, x + draw.randrange(5, 60), y + draw.choice([10, 15, 30])))
    rows += [(9, 1000, "one", 5, 5, 9, 9)] + [(10, 2000 + i, "z", 0, 7, 20, 17) for i in range(60)]  # one region; many in one place
    want = {}
    for sheet in {r[0] for r in rows}:
        lines, anchor = [], None
        for r in sorted((r for r in rows if r[0] == sheet), key=lambda r: (r[4], r[3], r[1])):
            h = r[6] - r[4]
            if anchor and abs(r[4] - anchor[0]) <= 10 and abs(h - anchor[1]) <= 10 and r[3] - anchor[2] <= 30:
                lines[-1] += " " + r[2]
                anchor = (anchor[0], anchor[1], r[5])
            else:
                lines.append(r[2])
                anchor = (r[4], h, r[5])
        want |= {(sheet, i): line for i, line in enumerate(lines)}
    found = lines_of(spark.createDataFrame(rows, "sheet long, id long, text string, x1 int, y1 int, x2 int, y2 int"))
    assert {(r.sheet, r.place): r.line for r in found.collect()} == want
    assert any(line.count(" ") > 1 for line in want.values()) and lines_of(found.sparkSession.createDataFrame([], "sheet long, id long, text string, x1 int, y1 int, x2 int, y2 int")).count() == 0


def test_median_with_an_outlier_and_ties(spark, tmp_path):
    draw = random.Random(6)
    values = {"view": [draw.random() for _ in range(30_001)] + [1e300], "click": [0.5] * 2000 + [-1e300], "error": [3.0], "signup": [1.0, 2.0], "purchase": [draw.choice([1.0, 2.0]) for _ in range(999)]}
    rows = [(k, v) for k, held in values.items() for v in held] + [("view", None)]
    draw.shuffle(rows)
    pq.write_table(pa.table({"event_type": [k for k, _ in rows], "value": pa.array([v for _, v in rows], pa.float64())}), tmp_path / "events.parquet")
    found = sorted(r.median for r in upper_median(spark, str(tmp_path)).collect())
    assert found == sorted(sorted(held)[len(held) // 2] for held in values.values())
