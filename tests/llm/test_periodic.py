"""Periodic runs against a search over all periods and places."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from graniteflow.llm.periodic import Index, op13_periodic, periodic_runs, runs, runs_of_texts, tailed


def plain(words, least=1, times=2):
    """All maximal runs, by start, then period."""
    n, out = len(words), []
    for p in range(1, n):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(least, times * p) and not any(all(words[x] == words[x + q] for x in range(i, i + length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def drawn(rnd, longest):
    words = [rnd.randrange(rnd.choice([1, 2, 2, 3, 5])) for _ in range(rnd.randint(0, longest))]
    if rnd.random() < 0.5 and len(words) > 6:
        at, p = rnd.randrange(len(words) // 2), rnd.randint(1, len(words) // 3)
        words[at:] = (words[at : at + p] * len(words))[: len(words) - at]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_of_small_alphabets(seed):
    rnd = random.Random(seed)
    for _ in range(400):
        words = drawn(rnd, 45)
        start, length, period = runs(np.array([*words, 99]))
        assert sorted(zip(start.tolist(), length.tolist(), period.tolist(), strict=True), key=lambda r: (r[0], r[2])) == plain(words), words


def test_runs_of_several_texts_at_once():
    rnd = random.Random(9)
    texts = [drawn(rnd, 150) for _ in range(200)]
    found = runs_of_texts([np.array(x, np.int64) for x in texts])
    assert found == [plain(x, 24, 3) for x in texts]
    assert sum(map(len, found)) > 50


@pytest.mark.parametrize("words", ["abaababaabaab" * 4, "a" * 200, "ab" * 90 + "ba" * 70, "abcabcabdabcabcabd" * 9])
def test_fibonacci_like_and_unary_words(words):
    words = [ord(c) for c in words]
    start, length, period = runs(np.array([*words, 0]))
    assert sorted(zip(start.tolist(), length.tolist(), period.tolist(), strict=True), key=lambda r: (r[0], r[2])) == plain(words)


def test_extensions_and_blocks():
    rnd = random.Random(3)
    words = np.array([*drawn(rnd, 80), *drawn(rnd, 80), 99])
    index, n = Index(words), len(words)
    for a in range(n):
        for b in range(n):
            if a != b:
                ahead = next(i for i in range(n) if a + i >= n or b + i >= n or words[a + i] != words[b + i])
                behind = next(i for i in range(n + 1) if a - i - 1 < 0 or b - i - 1 < 0 or words[a - i - 1] != words[b - i - 1])
                assert index.ahead(np.array([a]), np.array([b]))[0] == ahead and index.behind(np.array([a]), np.array([b]))[0] == behind
    ends = index.blocks().tolist()
    text = words.tolist()
    earlier = lambda i, m: any(text[j : j + m] == text[i : i + m] for j in range(i))
    assert ends[0] == 0 and ends[-1] == n
    for i, j in zip(ends, ends[1:], strict=False):
        assert (j - i == 1 or earlier(i, j - i)) and (j == n or not earlier(i, j - i + 1))


def expected(doc_id, text, edit):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h, n = (1 if doc_id is None else zlib.crc32(str(doc_id).encode())), len(words)
    if edit and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain(words, 24, 3)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    dropped = {i for s, m, p in found for i in range(s + p, s + m)}
    digest = lambda x: sha256(x.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest("".join(f"{s},{m},{p}\n" for s, m, p in found)), digest(kept))


HARD = [
    (1, None), (2, ""), (3, " \n\t"), (None, "la " * 40), (4, "la " * 40), (4, "la " * 40), (5, "a b c\x1cd e f " * 9), (6, "x y " * 12 + "z " * 30 + "x y " * 12),
    (7, "a a b a a b " * 8), (8, "wide space " * 30), (9, "one two three four five six seven eight " * 3), (10, "one two three four five six seven eight " * 2),
]


@pytest.mark.parametrize("edit", [False, True])
def test_hard_texts(spark, edit):
    more = [(i, f"w{i} " + "p q r s t u v " * (i % 9)) for i in range(100, 160)]  # some ids have edited texts
    found = periodic_runs(spark.createDataFrame(HARD + more, "doc_id long, text string"), edit).collect()
    assert [tuple(r) for r in found] == [expected(i, text, edit) for i, text in HARD + more]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(r["text"]) < 6000]
    assert len(short) > 150
    found = {r["doc_id"]: tuple(r) for r in op13_periodic(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(docs)
    assert [found[r["doc_id"]] for r in short] == [expected(r["doc_id"], r["text"], True) for r in short]


def test_long_text_of_one_period_and_empty_table(spark):
    words = [f"w{i}" for i in range(997)] * 60
    assert runs_of_texts([np.array([int(w[1:]) for w in words])]) == [[(0, len(words), 997)]]
    assert tailed([b"a", b"b"], None) == [b"a", b"b"]
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([(1, "la " * 30, 7)], "doc_id int, text string, period int")
    assert periodic_runs(clash).first()["period"] == 1
