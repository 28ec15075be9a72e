import random

import numpy as np

from graniteflow.llm import neardup
from graniteflow.llm.neardup import Shingler, classes, components, deduplicated, joined, mix, signatures, weighted

SCHEMA = "doc_id long, text string, node int, class_id string"


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def brute(rows):
    texts = sorted({t or "" for _, t in rows})
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for d, t in rows:
        r = find(texts.index(t or ""))
        least[r] = min(least.get(r, d), d)
    return {d: least[find(texts.index(t or ""))] for d, t in rows}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, n = [], 0
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = word()
            rows.append((n, " ".join(text)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "a b c"), (n + 4, "A  b C"), (n + 5, "same " * 5000), (n + 6, "same " * 4000)]


def test_classes_against_brute_force(spark):
    rows = corpus()
    out = {r["doc_id"]: r for r in classes(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()}
    assert {i: r["class_id"] for i, r in out.items()} == brute(rows)
    kept = [i for i, r in out.items() if r["is_kept"]]
    assert sorted(kept) == sorted(set(brute(rows).values()))
    left = deduplicated(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(kept) and left.columns == ["doc_id", "text", "node", "class_id"]


def test_repeats_nulls_and_empty_table(spark):
    rows = [(1, "one two three four five six", 0, ""), (1, "one two three four five six", 0, ""), (None, "one two three four five six", 0, ""), (None, "alone here", 0, "")]
    out = classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r["class_id"]) for r in out) == ["1", "1", "1", "None"]
    assert sorted(str(r["doc_id"]) for r in deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()) == ["1", "None", "None"]
    assert classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(1)
    base = mix(np.arange(600, dtype=np.uint64))
    a, b = rng.uniform(0.3, 4, 600), rng.uniform(0.3, 4, 600)
    a[400:], b[:100] = 0, 0
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = []
    for seed in range(60):
        x = mix(base ^ np.uint64(seed * 7919 + 1))
        s = signatures([x[a > 0], x[b > 0], x[:1]], [a[a > 0], b[b > 0], np.ones(1)])
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - true) < 0.025


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(4).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(199)] + [(500, 501)], "a long, b long")
    out = dict(map(tuple, components(links).collect()))
    assert {out[i] for i in range(200)} == {0} and out[500] == out[501] == 500


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TOGETHER", 4)
    s = Shingler()
    texts = [" ".join(f"{c}{i // 3}" for c in "uvwxyz") + f" a b c d e f g h i j k l m n o p q r s {i % 3}" for i in range(30)]
    pairs = [weighted(s(t)) for t in texts]
    sig = signatures([v for v, _ in pairs], [w for _, w in pairs])
    sets = [np.unique((s(t) >> np.uint64(32)).astype(np.uint32)) for t in texts]
    links = {(i, j) for j in range(30) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}

    def least(pairs):
        label = list(range(30))
        for _ in range(30):
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        return label

    schema = "bucket long, node long, component long, signature binary, shingles binary"
    rows = spark.createDataFrame([(7, i, i, bytearray(sig[i].tobytes()), bytearray(sets[i].tobytes())) for i in range(30)], schema)
    found = {tuple(r) for r in joined(rows).collect()}
    assert found <= links and least(found) == least(links) and len(set(least(links))) == 10


def pasted(count=12, seed=9):
    """Texts, each with itself pasted 4 and 10 times: exact similarities are over 0.9."""
    rng = random.Random(seed)
    bases = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80)) for _ in range(count)]
    return [" ".join([t] * n) for t in bases for n in (1, 4, 10)]


def test_repeated_text_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(pasted())]
    out = {r["doc_id"]: r["class_id"] for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == brute(rows) == {i: i // 3 * 3 for i in range(len(rows))}


def test_repeated_text_in_a_large_bucket(spark):
    s, texts = Shingler(), pasted()
    pairs = [weighted(s(t)) for t in texts]
    sig = signatures([v for v, _ in pairs], [w for _, w in pairs])
    sets = [np.unique((s(t) >> np.uint64(32)).astype(np.uint32)) for t in texts]
    schema = "bucket long, node long, component long, signature binary, shingles binary"
    rows = spark.createDataFrame([(7, i, i, bytearray(sig[i].tobytes()), bytearray(sets[i].tobytes())) for i in range(len(texts))], schema)
    parts = dict(map(tuple, components(joined(rows)).collect()))
    assert parts == {i: i // 3 * 3 for i in range(len(texts))}


def test_null_and_repeated_ids_against_brute_force(spark):
    rng = random.Random(11)
    base = [["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)] for _ in range(6)]
    text = lambda n, *more: " ".join([*base[n], *more])
    rows = [
        (1, text(0)), (None, text(0, "more")), (None, text(1)), (None, text(1, "more")), (5, text(2)), (5, text(3)), (3, text(3, "more")),
        (5, text(4)), (4, text(2, "more")), (5, text(4)), (None, text(5)), (None, text(5)), (5, text(3, "x", "y")),
    ]
    out = classes(spark.createDataFrame(rows, "doc_id long, text string"))
    group_of = {text(n, *more): n for n in range(6) for more in ((), ("more",), ("x", "y"))}
    want = {0: 1, 1: None, 2: 4, 3: 3, 4: 5, 5: None}
    by_node = {r["node"]: t for r, t in [(r, r["text"]) for r in neardup.with_node(spark.createDataFrame(rows, "doc_id long, text string")).collect()]}
    found = [(r["doc_id"], group_of[by_node[r["node"]]], r["class_id"]) for r in out.collect()]
    assert sorted(found, key=repr) == sorted(((d, group_of[t], want[group_of[t]]) for d, t in rows), key=repr)
    left = deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((group_of[r["text"]], r["doc_id"]) for r in left if r["doc_id"]) == [(0, 1), (2, 4), (3, 3), (4, 5)]
    assert sorted(group_of[r["text"]] for r in left if r["doc_id"] is None) == [0, 1, 1, 5]  # rows without an id stay


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: r["class_id"] for r in classes(docs).collect()} == brute(rows)
