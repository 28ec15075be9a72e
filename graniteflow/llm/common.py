"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one in ``spark.checkpoint.dir``. Only where that is unset, as in tests on one machine, a
    temporary folder is made and set; on a cluster, whose machines wouldn't share it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="graniteflow-")
        spark.conf.set("spark.checkpoint.dir", found)
        _written.append((spark, found))
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows of df, written to the shared folder and read again.

    It cuts the lineage: a lost executor costs the tasks that read its partitions, not the work before.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in reversed(_written):
        try:
            delete_path(spark, path)
        except Exception:  # the session is gone: nothing can be removed any more
            return


def held_out(doc_id: Column | str) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    at = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(at.cast("string").cast("binary")), F.lit(0)) % 4 == 2
