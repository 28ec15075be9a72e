"""Session helpers: the settings every job of this library relies on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

#: Tables that the example catalogue reads, each ``<dir>/<name>.parquet``.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "graniteflow", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling; cluster settings stay with the submitter."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the catalogue; columns are pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """How many tasks a shuffle has, as the submitter set it. Given outright to repartition(), it stays: few bytes of many rows aren't joined into few tasks."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(rows: DataFrame, key: Column | str) -> DataFrame:
    """rows dealt out by key over three tasks a core, or as many as a shuffle has if these are fewer.

    Narrow rows are few bytes on disk: a million are read in one or two tasks, which would do all that follows up to the next shuffle.
    """
    return rows.repartition(min(parts(rows.sparkSession), 3 * rows.sparkSession.sparkContext.defaultParallelism), key)
