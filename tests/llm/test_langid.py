import random
import zlib

import numpy as np
import pytest

from graniteflow.llm import langid
from graniteflow.llm.common import held_out
from graniteflow.llm.langid import WINDOW, Network, identify, identify_texts, train_on_fold, windows_of

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int"
SYLLABLES = {"aa": ["the", "ing", "th", "er", "on"], "bb": ["ée", "eau", "oi", "que", "le"], "cc": ["sch", "ung", "ß", "ein", "ch"]}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    make = lambda lang: " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.choice([3, 30, 300])))
    return [(i, make(lang), lang, "x", 1) for i in range(n) for lang in [rng.choice("abc") * 2]]


@pytest.fixture(scope="module")
def model(spark):
    return train_on_fold(spark.createDataFrame(corpus() + [(9999, "no label", None, None, None)], SCHEMA))


def test_held_out_accuracy(spark, model):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = identify(docs, model).withColumn("held_out", held_out("doc_id")).collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out) and model.labels == ["aa", "bb", "cc"]


def test_edges(spark, model):
    rows = [(1, None, None, None, None), (None, "", None, None, None), (2, "123 !? ²", None, None, None), (3, "que leeau " * 30_000, None, None, None), (3, "que leeau", None, None, None)]
    out = [(r["doc_id"], r["lang_pred"]) for r in identify(spark.createDataFrame(rows, SCHEMA), model).collect()]
    assert out == [(1, "und"), (None, "und"), (2, "und"), (3, "bb"), (3, "bb")]
    assert identify(spark.createDataFrame([], SCHEMA), model).collect() == []
    assert train_on_fold(spark.createDataFrame([], SCHEMA)).labels == ["und"]


def test_batches_of_windows_agree_with_single_texts(model):
    texts = [t for _, t, *_ in corpus(40, 5)]
    together = list(identify_texts(model, texts, most=7))
    for text, (lang, score) in zip(texts, together, strict=True):
        (alone,) = identify_texts(model, [text])
        assert alone[0] == lang and abs(alone[1] - score) < 1e-5
    assert windows_of(b"x" * (WINDOW + 1)).shape == (2, WINDOW)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    windows, target = rng.integers(1, 255, (6, WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    net = Network(["a", "b"])
    loss = lambda: -np.log(net.forward(windows)[0][np.arange(6), target]).mean()
    before = loss()
    net.fit(windows, target, epochs=40, batch=6, rate=0.01)
    assert loss() < before


def test_windows_against_plain_loops():
    """The network's pass against its definition in plain loops: filters of each width slid over bytes, their largest value, softmax."""
    rng = np.random.default_rng(4)
    net = langid.Network(["a", "b", "c"])
    net.conv *= 2
    data = [bytes(rng.integers(1, 256, n).tolist()) for n in (1, 2, 5, 40)]
    got = net(np.concatenate([langid.windows_of(d) for d in data]))
    for row, d in zip(got, data, strict=True):
        wide = list(d) + [0] * (langid.WINDOW + langid.SPAN - 1 - len(d))
        hidden = []
        for f in range(net.conv.shape[1]):
            width = langid.WIDTHS[f // langid.FILTERS]
            at = lambda i, f=f, width=width: sum(float(net.embed[wide[i + k]] @ net.conv[k * langid.SIZE : (k + 1) * langid.SIZE, f]) for k in range(width))
            hidden.append(max(0.0, max(map(at, range(langid.WINDOW))) + float(net.bias[f])))
        z = np.array(hidden) @ net.out + net.base
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(row, want, atol=1e-4)


def test_texts_of_many_windows_against_one_at_a_time():
    rng = np.random.default_rng(5)
    net = langid.Network(["a", "b"])
    texts = ["".join(rng.choice(list("abcdé漢 "), n)) for n in (1, 300, 2000, 7)] + [None, "", "12 3"]
    found = list(langid.identify_texts(net, texts, most=3))
    for t, (lang, score) in zip(texts, found, strict=True):
        if not t or not any(map(str.isalpha, t)):
            assert (lang, score) == ("und", 0.0)
            continue
        data = t.encode()
        parts = [data[i : i + langid.WINDOW] for i in range(0, len(data), langid.WINDOW)]
        p = sum(len(part) * net(langid.windows_of(part))[0] for part in parts) / len(data)
        assert lang == net.labels[int(p.argmax())] and abs(score - p.max()) < 1e-5
