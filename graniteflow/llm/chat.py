"""Chat formatting of reply trees, in DataFrame functions alone.

Messages answer one another; a branch is the path from a root to a leaf. Self-joins double how far each message
sees up its path in every round, so a path of n messages takes log2(n) rounds of narrow rows: they give each leaf its
branch's length and score. The best branches of a tree are chosen, the same doubled steps list their messages, the
texts are joined once and each branch becomes one conversation.

In a conversation every turn stands between two marks of its role. Control strings inside texts get a backslash after
their first letter (one more if they have some), so no text holds a mark, and taking one off gives the text again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graniteflow.llm.common import written

#: The marks of roles; of any other role the name stands between the marks in hexadecimal digits.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN ", "]", "[/TURN]")
#: What follows the first letter (< or [) of a mark.
REST = r"(<SYS>>|</SYS>>|/?INST\]|/?s>|TURN [0-9A-F]*\]|/TURN\])"
TURN = r"(?s)(<<SYS>>|\[INST\]|<s>|\[TURN [0-9A-F]*\])(.*?)(?:<</SYS>>|\[/INST\]|</s>|\[/TURN\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + REST, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + REST, r"$1$2$3")


def _by_role(role: Column, known: dict, other: Column) -> Column:
    return reduce(lambda out, x: F.when(role == x[0], x[1]).otherwise(out), known.items(), other)


def opening(role: Column) -> Column:
    name = F.hex(F.encode(role, "utf-8"))
    return _by_role(role, {r: F.lit(m[0]) for r, m in MARKS.items()}, F.concat(F.lit(OTHER[0]), name, F.lit(OTHER[1])))


def closing(role: Column) -> Column:
    return _by_role(role, {r: F.lit(m[1]) for r, m in MARKS.items()}, F.lit(OTHER[2]))


def role_of(mark: Column) -> Column:
    """The role whose opening mark this is."""
    name = F.decode(F.unhex(F.regexp_extract(mark, r"\[TURN ([0-9A-F]*)\]", 1)), "utf-8")
    return _by_role(mark, {m[0]: F.lit(r) for r, m in MARKS.items()}, name)


def turns_of(formatted: Column) -> Column:
    """An array of (role, text), read back from a formatted conversation."""
    turn = lambda mark, body: F.struct(role_of(mark).alias("role"), unescaped(body).alias("text"))
    return F.zip_with(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)), F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2)), turn)


def _answers(messages: DataFrame) -> DataFrame:
    """row and to, the row of the message that it answers, or null at a root."""
    known = messages.where("node is not null").groupBy("tree", "node").agg(F.min_by("row", F.struct("role", "text", "row")).alias("to"))
    asked = messages.select("row", F.col("tree").alias("_tree"), "parent")
    found = asked.join(known, asked["_tree"].eqNullSafe(known["tree"]) & (asked["parent"] == known["node"]), "left")
    return found.select("row", F.when(F.col("to") != F.col("row"), F.col("to")).alias("to"))


def _doubled(links: DataFrame, scores: DataFrame, rows: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Rounds of (row, to, depth, score, low): to is 2**k messages up in round k, depth, score and low are the number,
    the score and the least row of the messages passed. Round k has what round k - 1 hadn't ended; the last column of
    an ended path counts all of it. Also the rows of rounds that can't end, on a circle or below one, if there are any."""
    rounds = [written(links.join(scores, "row").select("row", "to", F.lit(1).cast("long").alias("depth"), "score", F.col("row").alias("low")), "paths")]
    while True:
        live = rounds[-1].where("to is not null")
        if live.isEmpty():
            return rounds, None
        if 1 << (len(rounds) - 1) > rows:
            return rounds, live
        state = reduce(DataFrame.unionByName, [r.where("to is null") for r in rounds[:-1]], rounds[-1])
        above = state.select(F.col("row").alias("_row"), F.col("to").alias("_to"), F.col("depth").alias("_depth"), F.col("score").alias("_score"), F.col("low").alias("_low"))
        rounds.append(
            written(
                live.join(above, live["to"] == above["_row"]).select(
                    "row", F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("score") + F.col("_score")).alias("score"), F.least("low", "_low").alias("low")
                ),
                "paths",
            )
        )


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """The messages of the ``top`` best branches of each tree: leaf, rank, at (from 1), row.

    messages: a written table of row (a long of its own for each row), tree, node, parent, role, text, score.
    A branch's score is its messages' mean score (null: 0); ties go to the longer branch, then to the lesser leaf.
    """
    scores = messages.select("row", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    links = written(_answers(messages), "answers")
    rows = messages.count()
    rounds, circle = _doubled(links, scores, rows)
    if circle is not None:  # the least row of each circle becomes a root
        roots = circle.select(F.col("low").alias("row")).distinct().withColumn("cut", F.lit(True))
        links = written(links.join(roots, "row", "left").select("row", F.when(F.col("cut").isNull(), F.col("to")).alias("to")), "answers")
        rounds, _ = _doubled(links, scores, rows)
    whole = reduce(DataFrame.unionByName, [r.where("to is null") for r in rounds]).select("row", "depth", "score")
    leaves = whole.join(links.where("to is not null").select(F.col("to").alias("row")).distinct(), "row", "left_anti")
    ranked = leaves.join(messages.select("row", "tree", "node"), "row")
    order = Window.partitionBy("tree").orderBy((F.col("score") / F.col("depth")).desc(), F.col("depth").desc(), F.col("node").asc_nulls_last(), "row")
    chosen = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    path = chosen.select(F.col("row").alias("leaf"), "rank", "row", F.col("depth").alias("at"))
    for k in reversed(range(len(rounds) - 1)):
        up = rounds[k].where("to is not null").select("row", "to")
        both = F.array(F.struct(F.col("row"), F.col("at")), F.struct(F.col("to").alias("row"), (F.col("at") - (1 << k)).alias("at")))
        path = path.join(up, "row", "left").select("leaf", "rank", F.inline(both)).where("row is not null")
    return path


def format_branches(messages: DataFrame, top: int = 1, loss_role: str = "assistant") -> DataFrame:
    """One conversation for each of the ``top`` best branches of each reply tree.

    messages: tree, node, parent (null, unknown or the node itself: a root), role, text, score. Returns
    tree, rank, formatted and loss_spans, the (start, length) in code points of the texts of ``loss_role``
    in it: what a model is trained on.

    Null texts and roles count as empty; a null tree is a tree; a message without a node can't be answered.
    Of messages that share a node, answers belong to the least by (role, text); the others are branches of
    their own. Where answers form a circle, the row numbered least becomes its root. An empty table gives no rows;
    other columns are ignored. A branch is one row, so it is put together in one task, however long.
    """
    rows = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "messages")  # written, so rows keep their numbers
    turns = branches(rows, top).join(rows.select("row", "tree", "role", "text"), "row")
    before, body, after = opening(F.col("role")), escaped(F.col("text")), closing(F.col("role"))
    turns = turns.select("leaf", "rank", "tree", "at", "role", before.alias("before"), F.explode(F.array(body)).alias("body"), after.alias("after"))
    length = F.char_length("before") + F.char_length("body") + F.char_length("after")
    upto = F.sum(length).over(Window.partitionBy("leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    span = F.struct((upto - F.char_length("after") - F.char_length("body")).alias("start"), F.char_length("body").cast("long").alias("length"))
    parts = turns.select("leaf", "rank", "tree", "at", F.concat("before", "body", "after").alias("part"), F.when(F.col("role") == loss_role, span).alias("span"))
    whole = parts.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.sort_array(F.collect_list(F.struct("at", "part", "span"))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return whole.select("tree", "rank", F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("formatted"), spans.alias("loss_spans"))


def threads(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees of one branch: each turn answers that before it, by (turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return conversations.select(F.col("conv_id").alias("tree"), at.alias("node"), "role", "text", F.lit(None).cast("double").alias("score")).withColumn("parent", F.col("node") - 1)


def digests(formatted: DataFrame) -> DataFrame:
    """op12's columns, read back from formatted conversations (tree, formatted)."""
    read = formatted.select(F.col("tree").alias("conv_id"), F.char_length("formatted").cast("long").alias("formatted_chars"), F.explode(F.array(turns_of(F.col("formatted")))).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    read = read.select("conv_id", "formatted_chars", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.explode(F.array(loss)).alias("loss"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: The conversation that op12's contract adds.
ADDED = "</s>[INST] ok [/INST]"


def op12_chat(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED).alias("text"))
    return digests(format_branches(threads(given.unionByName(added))))
