"""Texts, quantities, tiles and boxes against recorded values, and merging against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from graniteflow.functions import geometry as g
from graniteflow.functions import marks as m
from graniteflow.functions import nested
from graniteflow.functions import quantities as q
from graniteflow.operators.greedy import greedy_match, greedy_selection, meeting, overlap_edges, seed_groups
from graniteflow.plans.merging import alike_anywhere, merged_to_fixpoint
from graniteflow.functions.text import letters_alike

#: The four-tile sheet: text, tile, local box, confidence.
OFFSETS = [(0, 0), (350, 0), (0, 350), (350, 350)]
REGIONS = [
    ("KL1", 0, 350, 280, 390, 300, 0.95), ("200×300", 0, 100, 50, 180, 70, 0.92), ("A", 0, 50, 10, 70, 30, 0.98), ("施工图", 0, 10, 350, 80, 380, 0.88), ("KL1", 1, 10, 280, 50, 300, 0.93),
    ("KL2", 1, 150, 200, 190, 220, 0.96), ("C30", 1, 200, 100, 240, 120, 0.94), ("B", 1, 80, 10, 100, 30, 0.97), ("施工图", 2, 10, 20, 80, 50, 0.85), ("Z1", 2, 120, 150, 160, 170, 0.91),
    ("1500mm", 2, 200, 200, 280, 220, 0.89), ("HRB400", 2, 300, 300, 380, 320, 0.87), ("Z2", 3, 50, 150, 90, 170, 0.93), ("±0.000", 3, 150, 250, 220, 270, 0.90), ("1", 3, 300, 10, 320, 30, 0.98),
    ("备注：钢筋保护层厚度", 3, 20, 350, 200, 380, 0.82),
]


def sheet(spark):
    order = sorted(range(len(REGIONS)), key=lambda i: (-REGIONS[i][6], i))
    rows = []
    for place, i in enumerate(order):
        text, tile, x1, y1, x2, y2, conf = REGIONS[i]
        dx, dy = OFFSETS[tile]
        rows.append((1, place, text, x1 + dx, y1 + dy, x2 + dx, y2 + dy, conf))
    return spark.createDataFrame(rows, "grp int, id long, text string, x1 int, y1 int, x2 int, y2 int, conf double")


def test_four_tiles(spark):
    rows = sheet(spark)
    alike = letters_alike(F.lower("text"), F.lower("text_"))
    edges = meeting(rows, ((alike > 0.8) & (g.iou() > 0.3)) | ((g.iou() > 0.7) & (alike > 0.5))).union(alike_anywhere(rows, 0.9)).distinct()
    kept = rows.join(greedy_selection(rows, edges).where("kept"), "id")
    assert kept.count() == 14
    width = height = 750
    order = kept.orderBy((F.col("y1") + F.col("y2")) / 2 / height * 1000 + (F.col("x1") + F.col("x2")) / 2 / width)
    assert [r["text"] for r in order.collect()] == ["A", "B", "200×300", "C30", "KL2", "KL1", "施工图", "1", "Z1", "Z2", "1500mm", "±0.000", "HRB400", "备注：钢筋保护层厚度"]
    sim = m.edit_likeness(F.col("text"), F.col("text_"))
    assert greedy_selection(rows, meeting(rows, (sim >= 0.95) & (g.iou() > 0.5))).where("kept").count() == 15
    kinds = {r["text"]: r["k"] for r in rows.select("text", m.wide_type(F.col("text")).alias("k")).collect()}
    assert kinds["±0.000"] == "elevation" and kinds["C30"] == kinds["HRB400"] == kinds["KL1"] == "component_id" and kinds["A"] == "axis"
    assert kinds["200×300"] == kinds["1500mm"] == "dimension" and kinds["备注：钢筋保护层厚度"] == kinds["施工图"] == "unknown"  # ten characters are too few for a description


def test_tiling(spark):
    tiles = spark.range(1).select(F.inline(g.tiles_of(F.lit(3000), F.lit(4000)))).collect()
    assert len(tiles) == 6 and {(t["width"], t["height"]) for t in tiles} == {(1602, 1469)}
    assert {t["x"] for t in tiles} == {0, 1398} and {t["y"] for t in tiles} == {0, 1265, 2530}
    by = {(t["row"], t["col"]): (t["left"], t["top"], t["right"], t["bottom"]) for t in tiles}
    assert by[0, 0] == (0, 0, 204, 204) and by[2, 1] == (204, 204, 0, 0)
    assert spark.range(1).select(F.inline(g.tiles_of(F.lit(2048), F.lit(100)))).count() == 1


@pytest.mark.parametrize(
    "rule,args,want",
    [
        (q.plain_area, ("板", 2, 3, 0, 0), 6), (q.plain_area, ("墙", 2, 0, 3, 0), 6), (q.plain_area, ("梁", 0, 2, 3, 0), 6), (q.plain_area, ("柱", 0, 2, 3, 0), 6), (q.plain_area, ("未知", 2, 3, 4, 0), 12),
        (q.plain_volume, ("板", 2, 3, 0, 0.1), 0.6), (q.plain_volume, ("墙", 2, 0, 3, 0.1), 0.6), (q.plain_volume, ("梁", 2, 3, 4, 0), 24), (q.plain_volume, ("柱", 0, 2, 3, 4), 24), (q.plain_volume, ("未知", 2, 3, 4, 5), 24),
    ],
)
def test_plain_rules(spark, rule, args, want):
    found = spark.range(1).select(rule(F.lit(args[0]), *[F.lit(float(a)) for a in args[1:]])).first()[0]
    assert abs(found - want) < 1e-6


def test_quantities(spark):
    one = lambda *columns: spark.range(1).select(*columns).first()
    label = lambda *d: q.dimension_label(*[F.lit(float(x)) for x in d])
    assert list(one(label(0, 0, 0, 0), label(2, 3, 4, 0.1), label(2, 3, 4, 4))) == ["-", "L2000×W3000×H4000×T100", "L2000×W3000×H4000"]
    dims = q.dimensions(F.create_map(F.lit("长"), F.lit("6000"), F.lit("bxh"), F.lit("300x600"), F.lit("厚"), F.lit("x")))
    assert list(one(*dims.values())) == [6.0, 0.3, 0.6, 0.0, None]
    beam = q.take_off(F.lit("beam"), dims, F.lit(2.0))
    assert abs(one(beam)[0]["volume"] - 2.16) < 1e-9 and abs(one(beam)[0]["area"] - 0.36) < 1e-9
    empty = {k: F.lit(None).cast("double") for k in dims}
    assert one(*[q.take_off(F.lit(k), empty, F.lit(1.0)) for k in ("wall", "column", "beam", "slab", "foundation", "x")]) == (None,) * 6
    big = q.standard_quantity(F.lit("column"), F.lit(50.0), F.lit(50.0), F.lit(None).cast("double"), F.lit(50.0))
    assert one(big)[0] == 125000.0
    kinds = [q.component_type(F.lit(t)) for t in ("承重墙", "KZ 柱", "Main BEAM", "楼板", "承台", "?", "")]
    assert list(one(*kinds)) == ["wall", "column", "beam", "slab", "foundation", "unknown", ""]


def test_texts(spark):
    one = lambda *columns: list(spark.range(1).select(*columns).first())
    assert [tuple(x) for x in one(m.symbols_in(F.lit("kz12 JQ1")))[0]] == [("KZ", "12"), ("Q", "1"), ("JQ", "1")]
    assert [x["dimension"] for x in one(m.dimensions_in(F.lit("200x300 12mm φ8")))[0]] == ["200x300", "12mm", "12m", "φ8"]
    assert one(m.scales_in(F.lit("1:500")))[0] == ["1:50", "1:500"] and one(m.type_by_prefix(F.lit("LB1")))[0] == "梁"
    assert one(m.rebar(F.lit("Φ8@200")))[0] == (8, 200) and one(m.rebar(F.lit("8@200")))[0] is None
    assert one(m.edit_likeness(F.lit("KL-12"), F.lit("kl -13")), m.edit_likeness(F.lit("KL1"), F.lit("KL2")), letters_alike(F.lit("KZ12"), F.lit("KZ21"))) == [0.8, 0.0, 1.0]
    assert one(m.safe_float(F.lit(" 12mm")), m.safe_number(F.lit("约-1.5个")), m.purpose(F.lit("300")), m.date_in(F.lit("日期 2024.3.5")).cast("string")) == [12.0, -1.5, "可能为截面尺寸", "2024-03-05"]
    assert one(m.component_key(F.lit(None), F.lit("框架 柱"), F.lit("h1"), F.lit(-150.0), F.lit(250.0)), m.safe_name(F.lit("a/b c.pdf"))) == ["框架_柱_h1_-100_200", "a_b_c"]
    for f in (m.wide_type, m.narrow_type, m.collapsed, m.normal_id):
        assert one(f(F.lit(None).cast("string")))[0] is None
    reply = lambda t: F.try_variant_get(nested.reply(F.lit(t)), "$.a", "int")
    assert one(reply('```json\n{"a": 1}\n```'), reply("x {'a': 2} y"), reply("none"), reply("")) == [1, 2, None, None]


def boxes(n, seed):
    rng = random.Random(seed)
    return [(rng.randrange(3), i, x := rng.randrange(200), y := rng.randrange(200), x + rng.randrange(5, 60), y + rng.randrange(5, 60), rng.random()) for i in range(n)]


def overlap(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    s = max(0, w) * max(0, h)
    return s / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - s)


SCHEMA = "grp int, id long, x1 int, y1 int, x2 int, y2 int, score double"


def test_seed_groups_and_fixpoint_against_loops(spark):
    rows = boxes(150, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    seeds, used = {}, set()
    for a in rows:
        if a[1] in used:
            continue
        for b in rows:
            if b[1] not in used and b[1] >= a[1] and b[0] == a[0] and (b is a or overlap(a, b) > 0.2):
                used.add(b[1])
                seeds[b[1]] = a[1]
    edges = overlap_edges(df, 0.2)
    assert dict(map(tuple, seed_groups(df, edges).collect())) == seeds
    now = [(*r[:6], 1) for r in rows]
    while True:
        out, gone = [], set()
        for i, a in enumerate(now):
            if i in gone:
                continue
            group = [a] + [b for j, b in enumerate(now) if j > i and j not in gone and b[0] == a[0] and overlap(a, b) > 0.2 and not gone.add(j)]
            out.append((a[0], a[1], min(x[2] for x in group), min(x[3] for x in group), max(x[4] for x in group), max(x[5] for x in group), sum(x[6] for x in group)))
        if len(out) == len(now):
            break
        now = out
    found = merged_to_fixpoint(df.select("grp", "id", F.lit(1).alias("n"), F.lit(1).alias("pieces"), *g.BOX), 0.2)
    assert sorted(map(tuple, found.select("grp", "id", *g.BOX, "n").collect())) == sorted(now)


def test_greedy_match_against_a_loop(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(60), rng.randrange(60)): rng.randrange(6) / 5 for _ in range(400)}
    taken, want = set(), {}
    for a in range(60):
        best = max(((s, -b) for (x, b), s in pairs.items() if x == a and b not in taken), default=None)
        if best:
            want[a] = -best[1]
            taken.add(-best[1])
    df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a int, b int, score double")
    assert {r["a"]: r["b"] for r in greedy_match(df).collect()} == want
    assert greedy_match(df.limit(0)).collect() == []


def test_stored_components(spark):
    texts = ['{"name": "梁", "dimensions": {"length": 4, "b": "0.3"}, "quantity": 2, "more": [1]}', '{"name": null}', ' {"quantity": "x", "dimensions": null}', '{"dimensions": [1]}', '{"name": "a"', "[1]", "7", " ", None, '{"quantity": 0}']
    found = [tuple(r[0]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(q.stored_component(F.col("t"), q.parsed(F.col("t")))).collect()]
    bad = lambda error: (None, None, None, error)
    assert found == [("梁", {"length": "4", "b": "0.3"}, 2.0, None), ("", {}, 1.0, None), ("", {}, 0.0, None), bad("not readable"), bad("not readable"), bad("not an object"), bad("not an object"), bad("no text"), bad("no text"), ("", {}, 0.0, None)]
