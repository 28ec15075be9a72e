"""Write-back of changed rows to a partitioned table of Parquet files, from a stream or a batch.

Rows lie in partitions by a hash of their key. A batch reads and rewrites only the partitions that its keys fall in,
each as a whole and replaced at once; a partition that a batch has changed bears its number, so when a batch runs
again, after a failure or a restart, it finds what it has done and leaves it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns that the table has besides its own: partition, and the batch that changed the row last.
PART, BATCH = "_part", "_batch"


def part_of(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def last_values(changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row for each key: of every other column the last value that isn't null, by ``at`` and then by the value.

    Sums by key and column combine before the shuffle; a key with very many changes is no large group.
    """
    others = [c for c in changes.columns if c not in (*keys, at)]
    return changes.groupBy(*keys).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(at), F.col(c))))[c].alias(c) for c in others], F.max(at).alias(at))


def upserted(rows: DataFrame, changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """rows with changes: a change's values that aren't null replace the row's, other columns stay; new keys are added.

    Keys must not be null (such changes are dropped); equal keys of changes become one, by ``last_values``.
    """
    known = changes.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    new = last_values(known.select(*keys, *[c for c in known.columns if c not in keys]), keys, at)
    others = [c for c in rows.columns if c not in keys]
    old = rows.select(*keys, F.struct(*others).alias("_old"))
    both = old.join(new, keys, "full")
    value = lambda c: F.coalesce(F.col(c), F.col("_old")[c]) if c in new.columns else F.col("_old")[c]
    return both.select(*keys, *[value(c).alias(c) for c in others])


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table's rows with their partition and batch, or None where there is none yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException:
        return None


def write_back(changes: DataFrame, batch: int, path: str, keys: list[str], at: str, parts: int = 64) -> list[int]:
    """Applies one batch of changes (keys, at and any other columns) to the table at ``path``; the partitions that were rewritten.

    Partitions that bear this batch's number, or a later one, have it already and are left, and so are those that no
    change falls in. Columns that only the table or only the changes have are null in the others' new rows. ``parts`` is
    fixed when the table is made: choose it so that a partition is what a task or two can rewrite. An empty batch writes nothing.
    """
    spark = changes.sparkSession
    changes = changes.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).withColumn(PART, part_of(keys, parts))
    touched = {r[0] for r in changes.select(PART).distinct().collect()}  # numbers below ``parts``
    table = read_table(spark, path)
    if table is not None and touched:
        done = table.where(F.col(PART).isin(*touched)).groupBy(PART).agg(F.max(BATCH).alias("last")).where(F.col("last") >= batch).collect()
        touched -= {r[PART] for r in done}
    if not touched:
        return []
    changes = changes.where(F.col(PART).isin(*touched)).withColumn(BATCH, F.lit(batch).cast("long"))
    own = table if table is not None else changes.limit(0)
    for name, kind in changes.dtypes:
        if name not in own.columns:
            own = own.withColumn(name, F.lit(None).cast(kind))
    out = upserted(own.where(F.col(PART).isin(*touched)), changes, keys, at)
    # a key's partition follows from it; so many files as partitions that are written
    out.repartition(len(touched), PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return sorted(touched)


def writer(path: str, keys: list[str], at: str, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a stream of changes."""

    def apply(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # read for its partitions and for its rows
        try:
            write_back(held, number, path, keys, at, parts)
        finally:
            held.unpersist()

    return apply
