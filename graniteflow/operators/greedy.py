"""Selections, groups and matches in encounter order, as rounds of joins over a table of edges instead of a loop over a group.

Each round decides whatever no longer depends on undecided rows and takes it, with its edges, out of the
tables, so rounds get smaller; their number is at most the longest chain of edges. Once ``alone`` edges or fewer
are left, one task decides them in order, so long chains don't cost a round for each of their rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.functions.geometry import cells, iou
from graniteflow.session import parts

#: Open edges that one task may decide: 16 bytes each, some 25 MB as Python's objects.
ALONE = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir`` (set only where it is unset, as in tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="graniteflow-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows without their lineage, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def meeting(boxes: DataFrame, where: Column, cell: int = 200, reach: int = 0, give: dict[str, Column] | None = None) -> DataFrame:
    """(low, high) ids of boxes of one group for which ``where`` holds, and the columns of ``give``; columns of the later box end in '_'.

    boxes: grp, id, x1, y1, x2, y2 and what else is read. Boxes within ``reach`` of each other meet in the
    cells of a grid, by an equi-join on group and cell; a pair is given by the first cell that both touch.
    Cells are dealt out over all tasks of a shuffle, however few bytes the boxes are.
    """
    half = reach / 2
    side = boxes.withColumns({"gx": cells(F.col("x1") - half, F.col("x2") + half, cell), "gy": cells(F.col("y1") - half, F.col("y2") + half, cell)})
    side = side.withColumns({"fx": F.col("gx")[0], "fy": F.col("gy")[0]}).withColumn("gx", F.explode("gx")).withColumn("gy", F.explode("gy"))
    side = side.repartition(parts(boxes.sparkSession), "grp", "gx", "gy")  # both sides are then dealt out as the join asks
    other = side.withColumnsRenamed({c: f"{c}_" for c in side.columns if c not in ("grp", "gx", "gy")})
    both = side.join(other.hint("merge"), ["grp", "gx", "gy"]).where("id < id_ AND gx = greatest(fx, fx_) AND gy = greatest(fy, fy_)")
    return both.where(where).select(F.col("id").alias("low"), F.col("id_").alias("high"), *[c.alias(n) for n, c in (give or {}).items()])


def overlap_edges(boxes: DataFrame, least: float, cell: int = 200) -> DataFrame:
    """(low, high) ids of boxes of one group whose intersection over union is above ``least``. boxes: grp, id, x1, y1, x2, y2, no two of a group equal."""
    return meeting(boxes, iou("", "_") > least, cell)


def _selected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id and kept of the nodes of these edges (low, high), in the order of ids."""
    before: dict = {}
    for frame in frames:
        for low, high in zip(frame["low"].tolist(), frame["high"].tolist(), strict=True):
            before.setdefault(high, []).append(low)
            before.setdefault(low, [])
    kept: dict = {}
    for i in sorted(before):
        kept[i] = not any(kept[low] for low in before[i])
    yield pd.DataFrame({"id": list(kept), "kept": list(kept.values())}).astype({"id": "int64", "kept": "bool"})


def _matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a, b and score of the match of these candidates, in the order of a."""
    rows, taken = pd.concat([pd.DataFrame({"a": [], "b": [], "score": []}), *frames]).sort_values(["a", "score", "b"], ascending=[True, False, True]), set()
    found: dict = {}
    for a, b, score in zip(rows["a"].tolist(), rows["b"].tolist(), rows["score"].tolist(), strict=True):
        if a not in found and b not in taken:
            found[a] = (a, b, score)
            taken.add(b)
    yield pd.DataFrame(list(found.values()), columns=["a", "b", "score"]).astype({"a": "int64", "b": "int64", "score": "float64"})


def greedy_selection(nodes: DataFrame, edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """id and kept of each node: one is kept if no kept node before it, by id, has an edge (low, high) to it.

    Nodes without edges are kept. Null ids are dropped; an empty table gives no rows.
    """
    left = cut(nodes.where("id IS NOT NULL").select("id").distinct())
    known = left.withColumnRenamed("id", "low")
    edges = cut(edges.select("low", "high").where("low < high").join(known, "low", "left_semi").join(left.withColumnRenamed("id", "high"), "high", "left_semi").distinct())
    decided = []
    while (open_edges := edges.count()) > alone:
        heads = cut(left.join(edges.select(F.col("high").alias("id")).distinct(), "id", "left_anti"))
        gone = cut(edges.join(heads.withColumnRenamed("id", "low"), "low", "left_semi").select(F.col("high").alias("id")).distinct())
        decided += [heads.withColumn("kept", F.lit(True)), gone.withColumn("kept", F.lit(False))]
        out = heads.union(gone)
        left = cut(left.join(out, "id", "left_anti"))
        edges = cut(edges.join(out.withColumnRenamed("id", "low"), "low", "left_anti").join(gone.withColumnRenamed("id", "high"), "high", "left_anti"))
        if len(decided) % 16 == 0:  # the plan doesn't grow with the rounds
            decided = [cut(reduce(DataFrame.union, decided))]
    if open_edges:
        last = cut(edges.select(F.col("low").cast("long"), F.col("high").cast("long")).coalesce(1).mapInPandas(_selected, "id long, kept boolean"))
        decided.append(last)
        left = left.join(last, "id", "left_anti")
    return reduce(DataFrame.union, decided, left.withColumn("kept", F.lit(True)))


def seed_groups(nodes: DataFrame, edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """id and seed of each node, in encounter order: a node that no seed before it has an edge to is a seed; others go to the first such seed.

    It isn't the transitive closure: members don't draw in members of their own.
    """
    edges = cut(edges.select("low", "high"))
    kept = cut(greedy_selection(nodes, edges, alone))
    seeds = kept.where("kept").select(F.col("id").alias("low"))
    first = edges.join(seeds, "low", "left_semi").groupBy(F.col("high").alias("id")).agg(F.min("low").alias("first"))
    return kept.join(first, "id", "left").select("id", F.when(F.col("kept"), F.col("id")).otherwise(F.col("first")).alias("seed"))


def greedy_match(candidates: DataFrame, alone: int = ALONE) -> DataFrame:
    """a, b and score of a one-to-one match in encounter order: each a, by id, takes its best b that none before it took; ties go to the least b.

    candidates: a, b, score, no pair twice. A round settles each a whose best open b no open a before it could take.
    """
    edges, found = cut(candidates.select("a", "b", "score")), []
    while (open_edges := edges.count()) > alone:
        top = edges.groupBy("a").agg(F.max("score").alias("score"))
        best = edges.join(top, ["a", "score"]).groupBy("a", "score").agg(F.min("b").alias("b"))
        first = edges.groupBy("b").agg(F.min("a").alias("a"))
        settled = cut(best.join(first, ["a", "b"]).select("a", "b", "score"))
        found.append(settled)
        edges = cut(edges.join(settled.select("a"), "a", "left_anti").join(settled.select("b"), "b", "left_anti").select("a", "b", "score"))
        if len(found) % 16 == 0:
            found = [cut(reduce(DataFrame.union, found))]
    if open_edges:
        edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("score").cast("double")).coalesce(1).mapInPandas(_matched, "a long, b long, score double")
    return reduce(DataFrame.union, found, edges)
