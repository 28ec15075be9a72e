import itertools
import random
import zlib

import numpy as np
import pytest

from graniteflow.llm import toxicity
from graniteflow.llm.common import held_out
from graniteflow.llm.toxicity import chain, fit, score, spans_of, train_on_fold, training_texts

SCHEMA = "doc_id long, text string, score string, spans int"
LABELS = "doc_id long, quality int, toxic int"


def brute(e, step):
    n, total, one, two = len(e), 0.0, np.zeros(len(e)), np.zeros((len(e), 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(a * b for a, b in zip(e, y, strict=True)) + sum(step[y[i - 1], y[i]] for i in range(1, n)))
        total += w
        for i in range(n):
            one[i] += w * y[i]
            if i:
                two[i, y[i - 1], y[i]] += w
    return one / total, two / total


def test_forward_backward_against_enumeration(monkeypatch):
    rng = np.random.default_rng(0)
    step = np.array([[0.5, -0.7], [-0.2, 0.9]])
    docs = [rng.normal(0, 2, n) for n in (1, 2, 3, 4, 7, 9, 10)]
    starts = np.cumsum([0] + [len(d) for d in docs])[:-1]
    for block in (2, 3, 64):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        marginal, pairs = chain(np.concatenate(docs), starts, step)
        for d, s in zip(docs, starts, strict=True):
            one, two = brute(d, step)
            assert np.allclose(marginal[s : s + len(d)], one)
            assert np.allclose(pairs[s + 1 : s + len(d)], two[1:])


def corpus(n=500, seed=2):
    rng = random.Random(seed)
    plain = ["".join(rng.choices(["an", "er", "li", "to", "ka"], k=3)) for _ in range(80)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.choice([8, 60, 400]))
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "Villain", "fiendish" + rng.choice("abcdef")]))
        docs.append((i, " ".join(words), "x", 1))
        labels.append((i, 1, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def field(spark):
    docs, labels = corpus()
    return train_on_fold(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (99_999, 0, 1)], LABELS))


def test_held_out_documents_and_spans(spark, field):
    docs, labels = corpus()
    toxic = {i: y for i, _, y in labels}
    out = score(spark.createDataFrame(docs, SCHEMA), field).withColumn("held_out", held_out("doc_id")).collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in toxic if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in held) >= 0.97 * len(held)
    found = [r["text"][s["start"] : s["end"]].lower() for r in held if toxic[r["doc_id"]] for s in r["spans"]]
    assert len(found) > 50 and sum(any(w in f for w in ("scoundrel", "villain", "fiendish")) for f in found) >= 0.95 * len(found)


def test_edges(spark, field):
    rows = [(1, None, None, None), (None, "", None, None), (2, "!!", None, None), (3, "an er " * 60_000 + "villain scoundrel", None, None), (4, "VİLLAIN İ Villain scoundrel", None, None), (4, "an", None, None), (4, "an", None, None)]
    out = score(spark.createDataFrame(rows, SCHEMA), field).collect()
    assert [r["predicted"] for r in out] == [0, 0, 0, 1, 1, 0, 0] and all(0 <= r["score"] <= 1 for r in out)
    assert score(spark.createDataFrame([], SCHEMA), field).collect() == []
    none = train_on_fold(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS))
    assert score(spark.createDataFrame(rows, SCHEMA), none).count() == 7
    assert fit(["a", "b"], np.array([0.0, 0.0])).weight == {}


def test_spans_join_neighbours():
    assert spans_of("ab cd, ef gh", np.array([0.1, 0.9, 0.8, 0.2])) == [{"start": 3, "end": 9, "marginal": 0.9}]


def test_scores_do_not_depend_on_the_draw(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choices(["an", "er", "li", "to", "ka"], k=3)) for _ in range(80)]
    docs, labels = [], []
    for i in range(3000):
        bad = i % 10 == 0
        marked = bad or i % 10 == 1  # of the marked documents half are toxic
        docs.append((i, " ".join([*rng.choices(plain, k=20), *["villain", "scoundrel"] * marked]), None, None))
        labels.append((i, 1, int(bad)))
    docs, labels = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    for most in (100, 5000):
        out = score(docs, fit(*training_texts(docs, labels, most))).select("doc_id", "score").toPandas()
        marked = out["doc_id"] % 10 < 2
        assert abs(out["score"].mean() - 0.1) < 0.03 and abs(out["score"][marked].mean() - 0.5) < 0.15


def test_stretches_give_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = [1, 700, 64, 65, 3, 130]
    e, starts, step = rng.normal(0, 2, sum(sizes)), np.cumsum([0, *sizes])[:-1], np.array([[0.5, -0.7], [-0.2, 0.9]])
    want = chain(e, starts, step)
    monkeypatch.setattr(toxicity, "STRETCH", 2)
    marginal, pairs = chain(e, starts, step)
    assert np.allclose(marginal, want[0]) and np.allclose(pairs, want[1])
    assert np.allclose(chain(e, starts, step, pairs=False)[0], want[0])


def test_offsets_after_a_letter_of_two(spark, field):
    (row,) = score(spark.createDataFrame([(1, "İstanbul an villain er", None, None)], SCHEMA), field).collect()
    assert [row["text"][s["start"] : s["end"]] for s in row["spans"]] == ["villain"]


def test_scores_against_plain_loops(spark, field, monkeypatch):
    """Every document's score against forward-backward word by word in plain Python, at batches of few texts."""
    monkeypatch.setattr(toxicity, "BATCH", 3000)
    docs, _ = corpus(120, seed=6)
    move = np.exp(field.step)
    for r in score(spark.createDataFrame(docs, SCHEMA), field).collect():
        words = [w for w in "".join(c if c.isalnum() else " " for c in r["text"].lower()).split()]
        psi = [np.array([1.0, np.exp(field.emission(w))]) for w in words]
        forward, backward = [psi[0] / psi[0].sum()], [np.ones(2)]
        for p in psi[1:]:
            v = (forward[-1] @ move) * p
            forward.append(v / v.sum())
        for p in psi[:0:-1]:
            v = move @ (p * backward[-1])
            backward.append(v / v.sum())
        gamma = [a * b / (a @ b) for a, b in zip(forward, backward[::-1], strict=True)]
        m = np.clip([g[1] for g in gamma], 0, 1)
        top = min(max(m.max(), 1e-6), 1 - 1e-6)
        z = field.calibration @ [1, np.log(top / (1 - top)), np.log1p(m.sum())]
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-6


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "x" * 500, None, None)] * 50 + [(2, "short", None, None), (2, "other", None, None)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], LABELS)
    assert training_texts(docs, labels, longest=100)[0] == ["other"]
    assert sorted(training_texts(docs, labels)[0]) == ["other", "x" * 500]
