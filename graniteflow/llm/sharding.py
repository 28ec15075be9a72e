"""Sharding by sampled splitters.

A size-weighted sample of the keys gives quantile boundaries of many fine ranges; the records are
range-partitioned by them, overfull ranges are subdivided, and the ranges are dealt to the shards so
that the shards' bytes come out near equal. The key is a hash of the text, so equal texts share a range
and a shard; only a group larger than a whole shard is spread over several.

What reaches the driver is bounded by ``ranges`` and ``sample``: the sampled keys and one row for each
range. Records are numbered inside pieces of ranges, so no task sees more than one piece's rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graniteflow.llm.common import written

UNIFORM = 2.0**63


def splitters(keys: np.ndarray, weights: np.ndarray, ranges: int) -> np.ndarray:
    """Sorted lower bounds of ranges at the weighted quantiles; a key that holds two quantiles or more is alone in its range.

    Range r holds the keys in [bounds[r-1], bounds[r]). No keys: no bounds, one range.
    """
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, mass = keys[order], np.cumsum(weights[order])
    picked = keys[np.minimum(np.searchsorted(mass, mass[-1] * np.arange(1, ranges) / ranges), len(keys) - 1)]
    values, times = np.unique(picked, return_counts=True)
    heavy = values[(times >= 2) & (values < np.iinfo(np.int64).max)] + 1
    return np.union1d(values, heavy)


def deal(sizes: list[float], shards: int) -> list[int]:
    """A shard for each size, largest first to the emptiest shard; ties go to the lower number."""
    heap, out = [(0.0, s) for s in range(shards)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = heapq.heappop(heap)
        out[i] = shard
        heapq.heappush(heap, (load + sizes[i], shard))
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 8, ranges: int = 1024, sample: int = 32_768) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs`` (doc_id, text).

    ranges: how many fine ranges; it sets the size of a task when records are numbered, so raise it with
    the data (it is raised to four times the shuffle partitions by itself). sample: expected number of
    sampled keys, the bound of what the driver collects.

    Null text counts as no bytes and as an equal of the empty text. A null doc_id is kept. Repeated rows
    each get a slot, and a group of them larger than a shard is spread like any other: rows are told apart
    by a number that the table of keys keeps. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ranges = max(ranges, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = F.coalesce("text", F.lit(""))
    light = written(
        docs.select(
            "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("key"),
            F.monotonically_increasing_id().alias("row"),  # written, so it stays what it is when tasks run again
        ),
        "shard-keys",
    )
    total = light.agg(F.sum("size")).first()[0] or 0
    chance = F.col("size") * F.lit(sample / max(total, 1))
    draw = F.abs(F.xxhash64("row", F.lit("draw")) / F.lit(UNIFORM))
    drawn = light.where(draw < chance).select("key", F.greatest(chance, F.lit(1.0)).alias("weight")).toPandas()
    bounds = splitters(drawn["key"].to_numpy(np.int64), drawn["weight"].to_numpy(float), ranges)

    @F.pandas_udf(T.IntegerType())
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64), side="right").astype(np.int32))

    ranged = light.withColumn("range", range_of("key"))
    fills = (
        ranged.groupBy("range").agg(F.sum("size").alias("bytes"), (F.min("key") == F.max("key")).alias("alone")).orderBy("range").collect()
    )  # one row for each range at most
    fair = max(1.0, total / ranges)
    cuts = {f["range"]: int(np.ceil(f["bytes"] / fair)) for f in fills if f["bytes"] > 2 * fair}
    alone = {f["range"] for f in fills if f["alone"]}
    whole = {f["range"] for f in fills if f["alone"] and f["bytes"] <= total / shards}

    @F.pandas_udf(T.IntegerType())
    def piece_of(place: pd.Series, by_key: pd.Series, by_id: pd.Series) -> pd.Series:
        n = place.map(cuts).fillna(1).to_numpy(np.int64)
        by = np.where(place.isin(alone), by_id, by_key).astype(np.int64)
        return pd.Series((by % n).astype(np.int32))

    pieces = ranged.withColumn("piece", piece_of("range", F.xxhash64("key"), F.xxhash64("row")))
    found = pieces.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("range", "piece").collect()
    units: dict[tuple, float] = {}
    unit_of = lambda r: (r["range"], -1 if r["range"] in whole else r["piece"])
    for r in found:
        units[unit_of(r)] = units.get(unit_of(r), 0) + r["bytes"]
    shard_of = dict(zip(units, deal(list(units.values()), shards), strict=True))
    first, plan = [0] * shards, []
    for r in found:
        shard = shard_of[unit_of(r)]
        plan.append((r["range"], r["piece"], shard, first[shard]))
        first[shard] += r["n"]
    placed = spark.createDataFrame(plan, "range int, piece int, shard int, first long")
    order = Window.partitionBy("range", "piece").orderBy("key", "doc_id", "row")
    return (
        pieces.withColumn("place", F.row_number().over(order))
        .join(F.broadcast(placed), ["range", "piece"])  # its rows are bounded by ranges, a parameter
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place") - 1).alias("slot"))
    )


def op4_shard(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
