"""Signs of made-up results by cases, and deletions."""

import pytest

from graniteflow.plans.lists import DELETED, deletion
from graniteflow.plans.made_up import MARKERS, signs

RESULT, PART = "result long, project string, title string", "result long, place long, id string, width double, height double, length double"


def ids(result, names, size=None):
    return [(result, i, n, size or float(i + 1 + 10 * result), size or float(i + 200), size or float(i + 500)) for i, n in enumerate(names)]


def test_signs(spark):
    results = [(0, "Bridge", None), (1, None, "DEMO sheet"), (2, "a", "b"), (3, "a", "b"), (4, "a", "b"), (5, "a", "b"), (6, "a", "b"), (7, None, None), (8, "某" + MARKERS[0], ""), (9, "a", "b"), (10, "a", "b")]
    parts = [
        *ids(0, ["KZ-1", "L-7"]), *ids(2, ["KZ-1", "L-1", "KZ-2", "KZ-3"]), *ids(3, ["KZ-2", "L-1", "KZ-1", "KZ-3"]), *ids(4, ["Q-9", "Q-4", "x"]), *ids(5, ["Q-9", "Q-4"]),
        *ids(6, ["a", "b"], 0.3), *ids(9, ["a", None, ""]), *ids(10, ["KZ-1", "KZ-2", "L-5"]), *ids(99, ["KZ-1", "KZ-2", "KZ-3"]), (9, 7, "z", None, 0.0, None),
    ]
    found = {r.result: r for r in signs(spark.createDataFrame(results, RESULT), spark.createDataFrame(parts, PART)).collect()}
    want = {1: "marked", 8: "marked", 2: "counted", 4: "one_prefix", 6: "one_value"}
    assert sorted(found) == list(range(11))
    for result, r in found.items():
        assert [c for c in ("marked", "counted", "one_prefix", "one_value") if r[c]] == ([want[result]] if result in want else []), result
        assert r.made_up == (result in want)
    assert signs(spark.createDataFrame([], RESULT), spark.createDataFrame([], PART)).count() == 0


def test_deletion(spark):
    rows = spark.createDataFrame([(1, "F"), (2, "P"), (3, None), (3, "F"), (None, "F"), (5, "F")], "id long, status string")
    left, report = deletion(rows, (2, 3, 9, 3, None), "id", "status = 'P'")
    assert [(r.id, r.status, r.message) for r in report.orderBy("place").collect()] == [(2, "error", "being processed"), (3, "success", None), (9, "error", "not found"), (3, "success", None), (None, "error", "not found")]
    assert sorted((tuple(r) for r in left.collect()), key=str) == [(1, "F"), (2, "P"), (5, "F"), (None, "F")]
    with pytest.raises(ValueError, match="more than"):
        deletion(rows, tuple(range(DELETED + 1)), "id", "false")
    assert deletion(rows, (), "id", "false")[0].count() == 6
