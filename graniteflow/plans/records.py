"""Lists, look-ups and reconciliation of stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.session import table


def orders_page(spark: SparkSession, sf_dir: str, status: str | None = "O", page: int = 2, size: int = 20) -> DataFrame:
    """One page of the orders with a status (None: all), newest first; a limit is the feature."""
    rows = table(spark, sf_dir, "orders")
    rows = rows if status is None else rows.where(F.col("o_orderstatus") == status)
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").offset((page - 1) * size).limit(size).select("o_orderkey", "o_orderstatus", "o_orderdate")


def owner_status_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each owner by status, owners without any too. Orders are counted before the join."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    owners = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(counts, "c_custkey", "left")
    return owners.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("done", F.lit(0)).alias("done"))


def reuse_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders have line items and how many have none, by status."""
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_held", F.lit(True))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(keys, "o_orderkey", "left")
    return rows.groupBy("o_orderstatus", F.coalesce("_held", F.lit(False)).alias("reuse")).agg(F.count("*").alias("n"))


def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels against each other: in both, in one or the other."""
    docs, labels = (table(spark, sf_dir, t).select("doc_id").distinct().withColumn(t, F.lit(1)) for t in ("documents", "labels"))
    side = F.when(F.col("labels").isNull(), "document_only").when(F.col("documents").isNull(), "label_only").otherwise("both")
    return docs.join(labels, "doc_id", "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def patched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose price is replaced by the sum of their line items, where there are any."""
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("new"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(sums, "o_orderkey", "left")
    return rows.select("o_orderkey", F.coalesce("new", "o_totalprice").alias("price"), F.col("new").isNotNull().alias("patched"))


QUERIES = {f.__name__: f for f in (orders_page, owner_status_count, reuse_split, label_match, patched_orders)}
ORACLES = {
    "orders_page": "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20",
    "owner_status_count": "SELECT c_custkey, c_name, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL",
    "reuse_split": "SELECT o_orderstatus, count(*) AS n, reuse FROM (SELECT o_orderstatus, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS reuse FROM orders) GROUP BY ALL",
    "label_match": "SELECT CASE WHEN l.doc_id IS NULL THEN 'document_only' WHEN d.doc_id IS NULL THEN 'label_only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1",
    "patched_orders": "SELECT o_orderkey, coalesce(s, o_totalprice) AS price, s IS NOT NULL AS patched FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
}
