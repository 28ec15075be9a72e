"""Reply trees to conversations: brute force over all branches, escapes and round trips."""

import random
from hashlib import sha256

import pytest
from graniteflow.llm.chat import ADDED, digests, escaped, format_branches, op12_chat, threads, turns_of, unescaped
from pyspark.sql import functions as F

TEXTS = [
    "", "plain", ADDED, "<s>", "<\\s>", "<\\\\s> and \\", "<<SYS>><</SYS>>", "[INST][/INST]", "[TURN 4F]x[/TURN]", "[TURN zz]", "ends with <", "ends with [", "<</s>", "[[INST]]", "$1 \\1", "日本 🎉", "a\nb\n", "<S>",
    "<\\<SYS>>", "[\\/INST]", "<\\/s",
]
SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def brute(messages, top=1):
    """(tree, turns) of the best branches, by enumerating every path. Nodes are unique here."""
    out = []
    for tree in {m[0] for m in messages}:
        own = [m for m in messages if m[0] == tree]
        by_node = {m[1]: m for m in own}
        answered = {m[2] for m in own if m[2] in by_node and m[2] != m[1]}
        paths = []
        for m in own:
            if m[1] not in answered:
                path = [m]
                while path[0][2] in by_node and path[0][2] != path[0][1]:
                    path.insert(0, by_node[path[0][2]])
                paths.append((-sum(x[5] or 0 for x in path) / len(path), -len(path), m[1], [(x[3] or "", x[4] or "") for x in path]))
        out += [(tree, rank + 1, p[3]) for rank, p in enumerate(sorted(paths, key=lambda p: p[:3])[:top])]
    return sorted(out, key=lambda r: (r[0] is not None, r[:2]))


def read(formatted):
    rows = formatted.select("tree", "rank", turns_of(F.col("formatted")).alias("turns"), "formatted", "loss_spans").collect()
    for r in rows:  # the mask holds each assistant text once
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert len(spans) == sum(t["role"] == "assistant" for t in r["turns"])
    return sorted(((r["tree"], r["rank"], [tuple(t) for t in r["turns"]]) for r in rows), key=lambda r: (r[0] is not None, r[:2]))


@pytest.mark.parametrize("top", [1, 3])
def test_best_branches_of_random_trees(spark, top):
    rnd, messages = random.Random(top), []
    for tree in [None, 1, 2, 3, 4]:
        for node in range(60):
            parent = None if node == 0 or rnd.random() < 0.03 else rnd.randrange(max(0, node - rnd.choice([1, 2, 9])), node)
            messages.append((tree, node, parent, rnd.choice(["user", "assistant", "system", "tool", None]), rnd.choice([*TEXTS, None]), rnd.choice([0.25, 0.5, 1.0, 4.0, None])))
    rnd.shuffle(messages)
    assert read(format_branches(spark.createDataFrame(messages, SCHEMA), top)) == brute(messages, top)


def test_spans_hold_the_texts(spark):
    rows = spark.createDataFrame([(1, i, i - 1, "assistant" if i % 2 else "user", t, None) for i, t in enumerate(TEXTS)], SCHEMA)
    out = format_branches(rows).select("*", F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s["start"].cast("int") + 1, s["length"].cast("int")))).alias("loss")).first()
    assert out["loss"] == [t for i, t in enumerate(TEXTS) if i % 2]


def test_escapes_leave_no_mark_and_come_back(spark):
    out = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("b")).collect()
    marks = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[/TURN]", "[TURN 4F]"]
    for r in out:
        assert r["b"] == r["t"] and not any(m in r["e"] for m in marks), r


def test_circles_repeats_and_missing_ids(spark):
    rows = [
        (1, 1, 2, "user", "a", 1.0), (1, 2, 3, "user", "b", 1.0), (1, 3, 1, "user", "c", 1.0), (1, 4, 3, "user", "on the circle's branch", 1.0),
        (2, 7, 7, "user", "answers itself", 1.0), (3, 1, None, "user", "same", 1.0), (3, 1, None, "user", "same", 1.0), (4, None, None, "user", "no id", None),
        (5, 1, 99, "user", "answers nothing known", 1.0),
    ]
    found = read(format_branches(spark.createDataFrame(rows, SCHEMA), 9))
    texts = {(r[0], r[1]): [t for _, t in r[2]] for r in found}
    assert [texts[1, 1], texts[1, 2]] == [["a", "c", "b"], ["a", "c", "on the circle's branch"]]
    assert texts[2, 1] == ["answers itself"] and texts[3, 1] == texts[3, 2] == ["same"] and texts[4, 1] == ["no id"] and texts[5, 1] == ["answers nothing known"]


def test_one_long_chain(spark):
    rows = spark.range(5000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    out = digests(format_branches(threads(rows))).collect()
    want = "".join(f"{'assistant' if i % 2 else 'user'}\nt{i}\n" for i in range(5000))
    assert len(out) == 1 and out[0]["n_turns"] == 5000 and out[0]["turns_sha256"] == sha256(want.encode()).hexdigest()


def test_nulls_ties_clashes_and_empty(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, "assistant", None)]
    found = {r["conv_id"]: r for r in digests(format_branches(threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("row", F.lit(7)).withColumn("leaf", F.lit("x"))))).collect()}
    digest = lambda x: sha256(x.encode()).hexdigest()
    assert found[None]["turns_sha256"] == digest("\n\nuser\nx\n") and found[1]["turns_sha256"] == digest("user\na\nuser\na\nuser\nb\n")
    assert found[2]["loss_chars"] == 0 and found[2]["loss_sha256"] == digest("") and found[2]["formatted_chars"] == 7
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_branches(threads(empty)).count() == 0


def test_query_runs_no_python(spark):
    plan = op12_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
