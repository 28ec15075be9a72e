"""Groups around seeds, selections and set joins against plain loops; both ways of settling what is open."""

import random
import time
from difflib import SequenceMatcher

import pytest
from graniteflow.operators.greedy import greedy_match, greedy_selection, seed_groups
from graniteflow.operators.keyed import seeds_by_keys
from graniteflow.operators.similarity import alike_sets, bag
from graniteflow.plans.merging import merged_by_id_or_type
from graniteflow.plans.tiers import alike_codes, kind_likeness, semantic_seeds, tag_likeness, type_merge_seeds
from pyspark.sql import functions as F
from graniteflow.operators import keyed
from graniteflow.plans.merging import alike_keys


def seeds(n, gives, takes):
    """id to seed, by a loop."""
    given, out = {}, {}
    for i in n:
        mine = [given[k] for k in takes.get(i, ()) if k in given]
        out[i] = min(mine, default=i)
        if not mine:
            for k in gives.get(i, ()):
                given.setdefault(k, i)
    return out


@pytest.mark.parametrize("alone", [0, 7, 10_000])
def test_seeds_by_keys(spark, alone):
    rnd = random.Random(alone)
    gives = {i: {rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(0, 2))} for i in range(60)}
    takes = {i: {rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(0, 2))} for i in range(60)}
    table = lambda x: spark.createDataFrame([(i, k) for i, ks in x.items() for k in ks] + [(3, None), (None, "a")], "id long, key string")
    found = seeds_by_keys(spark.range(60), table(gives), table(takes), alone)
    assert {r["id"]: r["seed"] for r in found.collect()} == seeds(range(60), gives, takes)


def test_one_key_for_all_and_no_keys(spark):
    nodes = spark.range(2000)
    one = nodes.withColumn("key", F.lit("k"))
    assert {r["seed"] for r in seeds_by_keys(nodes, one, one, 0).collect()} == {0}
    none = one.limit(0)
    assert all(r["id"] == r["seed"] for r in seeds_by_keys(nodes, none, one).collect())
    assert seeds_by_keys(nodes.limit(0), none, none).count() == 0


@pytest.mark.parametrize("alone", [0, 20, 10_000])
def test_selection_and_match(spark, alone):
    rnd = random.Random(alone)
    edges = {tuple(sorted(rnd.sample(range(50), 2))) for _ in range(60)}
    kept = {}
    for i in range(50):
        kept[i] = not any(kept[a] for a, b in edges if b == i)
    table = spark.createDataFrame(sorted(edges), "low long, high long")
    assert {r["id"]: r["kept"] for r in greedy_selection(spark.range(50), table, alone).collect()} == kept
    want = {i: i if kept[i] else min(a for a, b in edges if b == i and kept[a]) for i in range(50)}
    assert {r["id"]: r["seed"] for r in seed_groups(spark.range(50), table, alone).collect()} == want
    rows = {(rnd.randrange(20), rnd.randrange(20)): rnd.choice([0.5, 0.6, 0.7]) for _ in range(80)}
    taken, match = set(), set()
    for a in range(20):
        if open_ := sorted((-s, b) for (x, b), s in rows.items() if x == a and b not in taken):
            taken.add(open_[0][1])
            match.add((a, open_[0][1], -open_[0][0]))
    found = greedy_match(spark.createDataFrame([(a, b, s) for (a, b), s in rows.items()], "a long, b long, score double"), alone)
    assert {tuple(r) for r in found.collect()} == match


def test_long_chain_takes_one_task(spark):
    begin = time.time()
    chain = spark.range(9_999).select(F.col("id").alias("low"), (F.col("id") + 1).alias("high"))
    found = greedy_selection(spark.range(10_000), chain)
    assert found.where("kept = (id % 2 = 0)").count() == 10_000
    assert time.time() - begin < 30


@pytest.mark.parametrize(("measure", "least"), [("jaccard", 0.6), ("jaccard", 1.0), ("dice", 0.8)])
def test_alike_sets(spark, measure, least):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(2), [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 7))]) for i in range(120)]
    want = set()
    for i, g, a in rows:
        for j, h, b in rows:
            x, y = set(a), set(b)
            if i < j and g == h and x and y:
                value = len(x & y) / len(x | y) if measure == "jaccard" else 2 * len(x & y) / (len(x) + len(y))
                if value >= least:
                    want.add((i, j, value))
    table = spark.createDataFrame([*rows, (500, 0, None)], "id long, grp int, items array<string>")
    found = [tuple(r) for r in alike_sets(table, least, measure, ("grp",)).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert bag(F.lit("abab")) is not None
    with pytest.raises(ValueError, match="unknown measure"):
        alike_sets(table, 0.5, "cosine")


def test_alike_codes(spark):
    rnd = random.Random(2)
    codes = {"".join(rnd.choice("KLZ12") for _ in range(rnd.randint(1, 7))) for _ in range(150)} | {"kz1", ""}
    want = {(a, b) for a in codes for b in codes if a and b and a != b and SequenceMatcher(None, a.lower(), b.lower()).ratio() > 0.8}
    found = [tuple(r) for r in alike_codes(spark.createDataFrame([(c,) for c in [*codes, *codes, None]], "code string")).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_semantic_and_type_seeds_against_loops(spark):
    rnd = random.Random(3)
    rows = [
        (rnd.randrange(2), i, rnd.choice(["KZ1", "KZ12", "KZ123", "L5", "", None]), rnd.choice(["柱", "梁", ""]), rnd.choice(["3x4", "3 X 4", "5x5", "", None]), rnd.choice([0, 1, 2, 5, None]), rnd.choice([0, 1, 3]))
        for i in range(90)
    ]
    size = lambda x: (x or "").replace(" ", "").lower()

    def edge(a, b):
        if a[0] != b[0]:
            return False
        if a[2] and a[2] == b[2]:
            return True
        fit = a[3] == b[3] and (not size(a[4]) or not size(b[4]) or size(a[4]) == size(b[4]))
        if fit and a[2] and b[2] and SequenceMatcher(None, a[2].lower(), b[2].lower()).ratio() > 0.8:
            return True
        near = None not in (a[5], b[5]) and abs(a[5] - b[5]) <= 1 and abs(a[6] - b[6]) <= 1 and (a[5:] != b[5:])
        return fit and near

    want = {}
    for i, row in enumerate(rows):
        want[i] = min((j for j in range(i) if want[j] == j and edge(rows[j], row)), default=i)
    table = spark.createDataFrame(rows, "grp int, id long, code string, kind string, dims string, row int, col int")
    assert {r["id"]: r["seed"] for r in semantic_seeds(table).collect()} == want
    boxes = [(rnd.randrange(2), i, rnd.choice(["梁", "主梁", "A", "a ", "", None]), x := rnd.randrange(60), y := rnd.randrange(60), x + 20, y + 20) for i in range(60)]

    def over(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        return max(w, 0) * max(h, 0) / (800 - max(w, 0) * max(h, 0)) > 0.5 if w > 0 and h > 0 else False

    kind = lambda x: (x or "").strip().lower()
    want = {}
    for i, b in enumerate(boxes):
        want[i] = min((j for j in range(i) if want[j] == j and boxes[j][0] == b[0] and (over(boxes[j], b) or kind(b[2]) and kind(boxes[j][2]) == kind(b[2]))), default=i)
    table = spark.createDataFrame(boxes, "grp int, id long, kind string, x1 int, y1 int, x2 int, y2 int")
    assert {r["id"]: r["seed"] for r in type_merge_seeds(table).collect()} == want


def test_likeness_of_kinds_and_tags(spark):
    rows = [("梁", "梁", 1.0), ("梁", "主梁", 0.8), ("KL", "kl ", 1.0), ("KL", "KL梁", 0.6), ("柱", "板", 0.0), ("", "", 0.0), (None, "梁", 0.0)]
    for a, b, want in rows:
        assert spark.range(1).select(kind_likeness(F.lit(a).cast("string"), F.lit(b).cast("string"))).first()[0] == want
    tags = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), (None, None)], "a array<string>, b array<string>")
    assert [r[0] for r in tags.select(tag_likeness(F.col("a"), F.col("b"))).collect()] == [1 / 3, 0.0, 0.0]


def test_merging_by_id_or_type_against_loops(spark):
    draw = random.Random(7)
    rows = []
    for i in range(160):
        x, y = draw.randrange(120), draw.randrange(120)
        rows.append([draw.choice("ab"), i, draw.choice(["KZ1", "L1", "", None, "Q"]), draw.choice(["beam", "wall", "", None]), draw.randrange(4), draw.randrange(1, 3), 1, x, y, x + draw.choice([0, 25, 30]), y + 28])
    rows.append(["a", 900, "Q", "wall", 0, 1, 1, None, 0, 5, 5])

    def alike(a, b):
        if a[0] != b[0] or None in (a[7], b[7]) or not ((a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3])):
            return False
        s = max(0, min(a[9], b[9]) - max(a[7], b[7])) * max(0, min(a[10], b[10]) - max(a[8], b[8]))
        return s > 0 and s / ((a[9] - a[7]) * (a[10] - a[8]) + (b[9] - b[7]) * (b[10] - b[8]) - s) > 0.4

    now = rows
    while True:
        out, gone = [], set()
        for i, a in enumerate(now):
            if i in gone:
                continue
            group = [a] + [b for j, b in enumerate(now) if j > i and j not in gone and alike(a, b) and not gone.add(j)]
            best = max(group, key=lambda r: r[4])
            out.append(a if len(group) == 1 else [a[0], a[1], *best[2:5], sum(r[5] for r in group), sum(r[6] for r in group), *[f(r[k] for r in group) for k, f in ((7, min), (8, min), (9, max), (10, max))]])
        if len(out) == len(now):
            break
        now = out
    found = merged_by_id_or_type(spark.createDataFrame(rows, "grp string, id long, label string, type string, richness long, n long, pieces long, x1 int, y1 int, x2 int, y2 int"), 0.4)
    key = lambda r: (r[0], r[1])
    assert sorted(map(list, found.collect()), key=key) == sorted(now, key=key) and len(now) < len(rows) - 10


def test_text_keys_pair_what_letters_pair(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.sample("abcdefghijklmn", rnd.choice([2, 9, 10, 11, 12, 13]))) for _ in range(150)] + ["", None, "AB", "ba", "a|b", "|ab"]
    rows = [(i, rnd.randrange(2), t) for i, t in enumerate(texts)]
    gives, takes = alike_keys(spark.createDataFrame(rows, "id int, grp int, text string"), 0.9)
    found = {(a["id"], b["id"]) for a in gives.collect() for b in takes.collect() if a["key"] == b["key"] and a["id"] < b["id"]}
    sets = [set((t or "").lower()) for t in texts]
    assert found == {(i, j) for i, g, _ in rows for j, h, _ in rows if i < j and g == h and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.9}
    assert len(takes.collect()) == len([s for s in sets if s])  # a set's rows aren't paired with each other


def test_keys_are_dealt_out(spark):
    rows = spark.createDataFrame([(i, str(i % 3)) for i in range(9)], "id long, key string")
    assert {r["id"]: r["seed"] for r in seeds_by_keys(rows, rows, rows, alone=1).collect()} == {i: i % 3 for i in range(9)}
    assert keyed._open(rows, rows)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
