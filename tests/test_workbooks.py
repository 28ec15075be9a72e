"""Workbooks: what a drawing's sheets hold, and the sheets as files."""

from graniteflow.plans.workbooks import TOTALS, quantity_workbook
from graniteflow.sources.files import export_sheets

SF = "/root/testdata/sf0.001"


def test_sheets_are_gapless_and_sums_agree(spark):
    rows = quantity_workbook(spark, SF).collect()
    sheets = {}
    for r in rows:
        sheets.setdefault((r.drawing_id, r.sheet), {})[r.place] = r.cells.split("|")
    assert sum(map(len, sheets.values())) == len(rows)  # no place twice
    for (drawing, sheet), found in sheets.items():
        if sheet == TOTALS:
            assert sorted(found)[:7] == [1, 3, 4, 5, 6, 7, 10] and sum(int(found[p][1]) for p in found if p > 10) == int(found[5][1])
            assert len([p for p in found if p > 10]) == sum(d == drawing for d, _ in sheets) - 1
        else:
            n = len(found) - 3
            assert sorted(found) == [1, 3, *range(4, 4 + n), n + 5] and [found[p][0] for p in range(4, 4 + n)] == [str(i) for i in range(1, n + 1)]
            assert int(found[n + 5][5]) == n and abs(sum(float(found[p][6]) for p in range(4, 4 + n)) - float(found[n + 5][6])) < 0.005 * n + 0.006


def test_sheets_as_files(spark, tmp_path):
    rows = [(d, s, p, f"{d},{s}|{p}") for d in (1, 2) for s in ("a", "b") for p in range(1, 40)] + [(3, "b", 1, None)]
    folder = str(tmp_path / "out")
    export_sheets(spark.createDataFrame(rows, "book long, sheet string, place long, cells string").repartition(5), folder, "book")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["sheet=a", "sheet=b"]
    for sheet in "ab":
        files = sorted((tmp_path / "out" / f"sheet={sheet}").glob("*.csv"))
        lines = [tuple(map(int, line.split(",")[:2])) for f in files for line in f.read_text().splitlines()]
        assert lines == sorted((d, p) for d, s, p, _ in rows if s == sheet)
