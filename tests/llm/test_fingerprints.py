import hashlib
import random
import re

from pyspark.sql import functions as F

from graniteflow.llm import fingerprints
from graniteflow.llm.fingerprints import differing_branches, differing_paragraphs, fingerprint_edits, with_fingerprint

SCHEMA = "doc_id long, text string, range int, fingerprint string"


def leaves(text):
    return [x for line in re.split(r"(?<=\n)", text) for x in re.findall(r"[^.!?\n]{1,32}[.!?\n]*|[.!?\n]+", line)]


def near(a, b):
    x, y = set(leaves(a)), set(leaves(b))
    return 1.0 if a == b else min(2 * len(x & y) / (len(x) + len(y)), 1 - 0.5 / (len(x) + len(y))) if x or y else 0.0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(text):
    """Sections of paragraphs, in plain Python: sections end after blank lines, paragraphs after line ends."""
    return [[p for p in re.split(r"(?<=\n)", s) if p] for s in re.split(r"(?<=\n\n)(?!\n)", text) if s]


def root(text):
    return sha("".join(sha("".join(map(sha, section))) for section in tree(text)))


def branches(text, other):
    mine, theirs = tree(text), tree(other)
    at = lambda x, i: x[i] if i < len(x) else None
    return [f"{i}.{j}" for i, s in enumerate(mine) for j, p in enumerate(s) if p != at(at(theirs, i) or [], j)]


def test_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["alpha", "béta", "γ", "d.", "e!\n", "f?\n\n", "漢字", "😀"])
    docs = [(i * 3, " ".join(word() for _ in range(rng.choice([0, 1, 4, 60, 400])))) for i in range(300)]
    docs += [(5000, None), (5001, ""), (5002, "x" * 20_000), (5003, docs[7][1])]
    out = {r["doc_id"]: r for r in fingerprint_edits(spark.createDataFrame([(*d, 1, "z") for d in docs], SCHEMA)).collect()}
    order = sorted(docs, reverse=True)
    assert len(out) == len(docs)
    for i, (k, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        r = out[k]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - near(t, edited)) < 1e-9
        assert abs(r["near_next"] - near(t, following)) < 1e-9
        assert r["fingerprint"][:64] == root(t) and r["edited_fingerprint"][:64] == root(edited)
        assert r["edited_branches"] == ",".join(branches(edited, t))
    assert len({r["fingerprint"] for r in out.values()}) == len({t or "" for _, t in docs})


def test_edges(spark):
    run = lambda rows: fingerprint_edits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert run([]) == []
    (only,) = run([(4, "abcdef", 0, "")])
    assert only["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and only["near_next"] == 1.0
    twice = run([(4, "same text", 0, ""), (4, "same text", 0, ""), (None, "other", 0, ""), (None, None, 0, "")])
    assert len(twice) == 4 and sorted(r["n_chars"] for r in twice) == [0, 5, 9, 9]


def test_branches_locate_edits(spark):
    df = spark.createDataFrame([("one\ntwo\n\nthree\nfour\n", "one\ntwo\n\nTHREE\nfour\n")], "a string, b string")
    df = with_fingerprint(with_fingerprint(df, "a", "a_"), "b", "b_")
    got = df.select(differing_paragraphs(F.col("a_fingerprint"), F.col("b_fingerprint")).alias("d"), "a_fingerprint").first()
    assert len(got["d"]) == 1 and got["a_fingerprint"].count(":") >= 4


def test_moved_paragraphs(spark):
    df = spark.createDataFrame([("one\ntwo\n\nthree\nfour\n", "one\ntwo\n\nfour\nthree\n"), ("a\n\nb\n", "b\n\na\n"), ("same\n", "same\n")], "a string, b string")
    df = with_fingerprint(with_fingerprint(df, "a", "a_"), "b", "b_")
    near = fingerprints.likeness(F.left("a_fingerprint", F.lit(64)), F.col("a_tags"), F.left("b_fingerprint", F.lit(64)), F.col("b_tags"))
    got = df.select(differing_branches(F.col("a_sections"), F.col("b_sections")).alias("d"), near.alias("near")).collect()
    assert [r["d"] for r in got] == [["1.0", "1.1"], ["0.0", "1.0"], []]
    assert 0.8 < got[0]["near"] < 1 and got[2]["near"] == 1


def test_hot_ids_are_dealt_to_several_ranges(spark):
    rows = [(None, f"text {i}") for i in range(600)] + [(7, f"other {i}") for i in range(600)] + [(i, "x") for i in range(8, 208)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_tie", F.xxhash64("text"))
    dealt, _ = fingerprints.with_next(docs, ranges=16)
    sizes = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}
    assert len(sizes) == 16 and max(sizes.values()) < 200 and dealt.where("guest").count() == 16
    out = fingerprint_edits(docs.drop("_tie"))
    assert out.count() == len(rows) and out.where("near_next IS NULL").count() == 0
