"""Ids equal those of the library that owns the vocabulary; decoding gives the texts again."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graniteflow.llm import pieces

VOCABULARY = ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "ca", "cab"]
SCORES = [-3.0, -2.5, -2.7, -2.9, -2.2, -3.1, -3.3, -4.0, -3.5, -3.2, -4.4]


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def entry(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def unigram_file() -> bytes:
    """A small unigram model, written field by field."""
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(p, s, 1) for p, s in zip(VOCABULARY, SCORES, strict=True)]]
    out = b""
    for piece, score, kind in pieces_:
        body = entry(1, piece.encode()) + b"\x15" + np.float32(score).tobytes() + b"\x18" + varint(kind)
        out += entry(1, body)
    trainer = b"\x18\x01"
    normalizer = entry(1, b"identity") + b"\x18\x01\x20\x00\x28\x01"
    return out + entry(2, trainer) + entry(3, normalizer)


@pytest.fixture(scope="module")
def bpe():
    return pieces.PieceModel()


def test_ids_are_the_librarys(bpe, spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r[0] for r in rows if r[0] is not None]
    rng = random.Random(1)
    texts += ["", " ", "  two  spaces ", "a\n\nb\tc", "naïve ☃ 你好", "x" * 5000, "".join(rng.choice("ab ") for _ in range(3000)), "don't!!", "▁mark"]
    for t in texts:
        assert np.frombuffer(bpe.encode(t), np.int32).tolist() == bpe.own.encode(t), t[:80]


def test_unigram_scores_are_best():
    own = pieces.PieceModel(data=unigram_file())
    assert own.kind == "unigram"
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(40)))
        found = np.frombuffer(own.encode(text), np.int32).tolist()
        full = "▁" + text.replace(" ", "▁") if text else ""
        assert "".join(own.texts[i] for i in found) == full
        best = [0.0] + [-1e9] * len(full)  # brute force over all cuts
        for end in range(1, len(full) + 1):
            for start in range(end):
                i = own.ids.get(full[start:end])
                if i is not None:
                    best[end] = max(best[end], best[start] + own.score[i])
        assert abs(sum(own.score[i] for i in found) - best[-1]) < 1e-4


def test_window_stays_small(bpe):
    """A text without spaces is committed piece by piece, not at its end."""
    rng = random.Random(3)
    text = "▁" + "".join(rng.choice("abcdefghijklmnop") for _ in range(20_000))
    parts = list(bpe.search(text))
    assert "".join(p for part in parts for p in part) == text
    assert max(sum(map(len, part)) for part in parts) < 50 * bpe.longest


def test_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 7), (2, "", 7), (None, "hello world", 7), (4, "hello world", 7), (4, "hello world", 7)], "doc_id long, text string, ids int"
    )
    out = pieces.encode(docs)
    rows = {(r["doc_id"], r["n_ids"]) for r in out.collect()}
    assert out.count() == 5 and {(1, 0), (2, 0)} <= rows
    back = sorted((r["doc_id"] or 0, r["text"]) for r in pieces.decode(out).collect())
    assert back == [(0, "hello world"), (1, ""), (2, ""), (4, "hello world"), (4, "hello world")]
    assert out.where(~F.col("round_trip")).count() == 0  # null counts as empty
    assert pieces.encode(docs.limit(0)).count() == 0
