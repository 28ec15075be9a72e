"""Documents of random shapes flattened, pruned and put together again, against recursive loops."""

import json
import random

import pytest
from graniteflow.operators.variants import assembled, flattened, pruned, recognised_lines
from graniteflow.plans.shapes import stored


def drawn(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 6 else 5)
    if kind == 5:
        return {rnd.choice(["a", "b", "c d", 'q"t', "é", "k.x"]) + str(i): drawn(rnd, depth + 1) for i in range(rnd.randrange(4))}
    if kind == 6:
        return [drawn(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return [None, "", rnd.choice(["x", "a\nb", 'say "hi"', "\\", "日本"]), rnd.randrange(-5, 10**12), rnd.choice([True, False])][kind]


def nodes(value, path="$"):
    out = [(path, value)]
    if isinstance(value, dict):
        for k, v in value.items():
            plain = k.isascii() and k.replace("_", "a").isalnum() and not k[0].isdigit()
            name = "." + k if plain else '."' + k.replace("\\", "\\\\").replace('"', '\\"') + '"'
            out += nodes(v, path + name)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += nodes(v, f"{path}[{i}]")
    return out


def rid(value, deep):
    """Without empty members; deep: what is left empty goes too."""
    if isinstance(value, dict):
        inner = {k: rid(v, deep) for k, v in value.items() if v is not None and v != "" and (deep or v != {})}
        return {k: v for k, v in inner.items() if not (deep and v == {})}
    if isinstance(value, list):
        return [rid(v, deep) for v in value if v is not None and v != ""]
    return value


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(8)
    return [{"r": drawn(rnd), "s": [drawn(rnd), drawn(rnd)]} for _ in range(60)] + [[], {}, 5, "text", [[[[[[1]]]]]]]


def test_every_node_is_found(spark, docs):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, None), (901, "{broken"), (902, "")], "id long, doc string")
    found = flattened(rows, "doc", ["id"]).collect()
    assert {(r["id"], r["kind"]) for r in found if r["id"] >= 900} == {(900, None), (901, "invalid"), (902, "invalid")}
    want = sorted((i, path) for i, d in enumerate(docs) for path, _ in nodes(d))
    assert sorted((r["id"], r["path"]) for r in found if r["id"] < 900) == want
    value = {(r["id"], r["path"]): (r["kind"], r["value"]) for r in found}
    for i, d in enumerate(docs):
        for path, v in nodes(d):
            kind, text = value[i, path]
            plain = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "bigint"
            assert kind == plain and text == (None if plain in ("object", "array", "null") else str(v).lower() if plain == "boolean" else str(v))


@pytest.mark.parametrize("deep", [False, True])
def test_pruned_and_assembled(spark, docs, deep):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id long, doc string")
    flat = flattened(rows, "doc", ["id"])
    assert {r["id"]: json.loads(r["doc"]) for r in assembled(flat, ["id"]).collect()} == dict(enumerate(docs))
    assert {r["id"]: json.loads(r["doc"]) for r in assembled(pruned(flat, ["id"], deep), ["id"]).collect()} == {i: rid(d, deep) for i, d in enumerate(docs)}


def test_empty_table_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, '{"a":1}', "x")], "id long, doc string, path string")
    assert [r["path"] for r in flattened(rows, "doc", ["id"]).collect()] == ["$", "$.a"]
    none = flattened(rows.limit(0), "doc", ["id"])
    assert none.count() == 0 and assembled(pruned(none, ["id"]), ["id"]).count() == 0


def test_lines_of_recognition(spark):
    line = [[[10, 20], [30, 20], [30, 40], [10, 40.5]], ["KL1", 0.9]]
    docs = [[[line, None, line]], [line, line], [[]], [], None, [line], [["odd"], [[1], ["x", 1]]], "text"]
    rows = spark.createDataFrame([(i, None if d is None else json.dumps(d)) for i, d in enumerate(docs)], "id_ long, doc string")
    found = sorted((r["id_"], r["id"], r["text"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in recognised_lines(rows, "doc", ["id_"]).collect())
    box = ("KL1", 10.0, 20.0, 30.0, 40.5)
    assert found == [(0, 0, *box), (0, 2, *box), (1, 0, *box), (1, 1, *box)]


def test_assembled_counts_nodes(spark):
    docs = spark.createDataFrame([(0, '{"a":[1,{"b":""},null],"c":{}}'), (1, None), (2, "7"), (3, "{"), (4, "[]")], "id int, doc string")
    flat = flattened(docs, "doc", ["id"])
    assert {r["id"]: r["n"] for r in assembled(flat, ["id"], count="n").collect()} == {0: 7, 1: 1, 2: 1, 3: 1, 4: 1}
    left = {r["id"]: (r["doc"], r["n"]) for r in assembled(pruned(flat, ["id"]), ["id"], count="n").collect()}
    assert left[0] == ('{"a":[1,{}]}', 4) and left[4] == ("[]", 1)


def test_stored_results_are_dealt_out_before_they_are_read(spark):
    assert stored(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
