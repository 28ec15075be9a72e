"""Groups around seeds in encounter order where likeness is told by keys, without a table of pairs.

A row gives keys (what it would draw in as a seed) and takes keys (by what it can be drawn in); a row that takes a key
which an earlier seed gives belongs to the least such seed. Least givers by key combine before the shuffle, so rows
that share a key cost as many rows as they are, not the square of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteflow.operators.greedy import ALONE, cut
from graniteflow.session import parts


def _settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id and seed of the open rows, one after the other: given is null for a key that is taken, else whether a seed gives it."""
    rows = pd.concat([pd.DataFrame({"id": pd.Series([], dtype="int64"), "key": [], "given": []}), *frames])
    seeds: dict = {}
    gives: dict = {}
    takes: dict = {}
    for i, key, given in zip(rows["id"].tolist(), rows["key"].tolist(), rows["given"].tolist(), strict=True):
        if given is None or given != given:  # taken
            takes.setdefault(i, []).append(key)
        elif given:
            seeds[key] = min(i, seeds.get(key, i))
        else:
            gives.setdefault(i, []).append(key)
    out = []
    for i in sorted(takes.keys() | gives.keys()):
        seed = min((seeds[key] for key in takes.get(i, ()) if key in seeds), default=i)
        out.append((i, min(i, seed)))
        if seed >= i:
            for key in gives.get(i, ()):
                seeds[key] = min(i, seeds.get(key, i))
    yield pd.DataFrame(out, columns=["id", "seed"], dtype="int64")


def _open(gives: DataFrame, takes: DataFrame) -> DataFrame:
    """Given keys that an open row takes, and whether the giver is a seed: nothing that it takes is open."""
    n = parts(gives.sparkSession)
    waiting = takes.select("id").distinct().withColumn("waits", F.lit(True)).hint("merge")
    asked = gives.select("id", "key").join(takes.select("key").repartition(n, "key").hint("merge"), "key", "left_semi")
    return asked.repartition(n, "id").join(waiting, "id", "left").select("id", "key", F.col("waits").isNull().alias("seed"))


def seeds_by_keys(nodes: DataFrame, gives: DataFrame, takes: DataFrame, alone: int = ALONE) -> DataFrame:
    """id and seed of each node, in the order of ids: a node is a seed (its own) unless it takes a key that a seed before it gives.

    nodes: id. gives, takes: id and key (any hashable type, the same in both); null keys and ids are dropped, repeats are one.
    Rounds settle the nodes that no open node comes before, until ``alone`` rows of keys or fewer are open,
    which one task settles in order. It isn't the transitive closure: members draw in nobody.
    Keys are dealt out over all tasks of a shuffle, as long texts that repeat are few bytes there and many in a task.
    The right sides are, as semi-joins are planned below what is dealt out on their left.
    """
    n = parts(nodes.sparkSession)
    known = nodes.where("id IS NOT NULL").select("id").repartition(n, "id").distinct()
    gives = cut(gives.select("id", "key").where("key IS NOT NULL").distinct().join(known.hint("merge"), "id", "left_semi"))
    takes = cut(takes.select("id", "key").where("key IS NOT NULL").distinct().join(known.hint("merge"), "id", "left_semi"))
    rows = lambda gives, takes: gives.unionByName(takes.select("id", "key", F.lit(None).cast("boolean").alias("given"))).coalesce(1)
    if gives.count() + takes.count() <= alone:
        found = cut(rows(gives.withColumn("given", F.lit(False)), takes).mapInPandas(_settled, "id long, seed long"))
        return known.join(found, "id", "left").select("id", F.coalesce("seed", "id").alias("seed"))
    # keys that nobody open takes, or nobody gives, don't matter
    open_takes = cut(takes.join(gives.select("key").repartition(n, "key").hint("merge"), "key", "left_semi"))
    open_gives = cut(_open(gives, open_takes))
    drawn = []
    while True:
        if open_takes.isEmpty():
            break
        if open_gives.count() + open_takes.count() <= alone:
            left = rows(open_gives.withColumnRenamed("seed", "given"), open_takes)
            drawn.append(cut(left.mapInPandas(_settled, "id long, seed long").where("seed < id").select("id")))
            break
        least = open_gives.groupBy("key").agg(F.min("id").alias("first"), F.min(F.when(F.col("seed"), F.col("id"))).alias("taker"))
        met = open_takes.join(least, "key", "left").groupBy("id").agg(F.min("first").alias("first"), F.min("taker").alias("taker"))
        state = cut(met.select("id", F.when(F.col("taker") < F.col("id"), False).when(F.coalesce(F.col("first"), F.col("id")) >= F.col("id"), True).alias("kept")))
        gone = state.where("NOT kept").select("id")
        drawn.append(gone)
        ended = state.where("kept IS NOT NULL").select("id")
        open_takes = cut(open_takes.join(ended, "id", "left_anti"))
        open_gives = cut(_open(open_gives.join(gone, "id", "left_anti"), open_takes))
    if not drawn:
        return known.select("id", F.col("id").alias("seed"))
    out = cut(reduce(DataFrame.union, drawn)).repartition(n, "id")
    taken = takes.join(out.hint("merge"), "id", "left_semi").repartition(n, "key")
    first = taken.join(gives.join(out.hint("merge"), "id", "left_anti").groupBy("key").agg(F.min("id").alias("seed")), "key").groupBy("id").agg(F.min("seed").alias("seed"))
    return known.join(first, "id", "left").select("id", F.coalesce("seed", "id").alias("seed"))
