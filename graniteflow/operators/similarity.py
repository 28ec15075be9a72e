"""Similarity joins of sets: pairs that are alike enough meet on a rare element, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bag(text: Column) -> Column:
    """A text's letters as a set: the second a is another element than the first."""
    letters = F.array_remove(F.split(text, ""), "")
    count = lambda x, i: F.size(F.filter(F.slice(letters, 1, i + 1), lambda y: y == x))
    return F.transform(letters, lambda x, i: F.concat(x, F.lit("#"), count(x, i).cast("string")))


def least_size(size: Column, least: float, measure: str) -> Column:
    """How large a set must be, at least, to be alike to one of this size."""
    return F.ceil(size * (least if measure == "jaccard" else least / (2 - least)) - 1e-9).cast("int")


def likeness(shared: Column, a: Column, b: Column, measure: str) -> Column:
    return shared / (a + b - shared) if measure == "jaccard" else 2 * shared / (a + b)


def alike_sets(rows: DataFrame, least: float, measure: str = "jaccard", by: tuple[str, ...] = ()) -> DataFrame:
    """(low, high, likeness) of ids whose sets are alike by ``least`` or more, of rows with equal columns ``by``.

    rows: id, items (array of strings) and the columns ``by``. measure: jaccard, or dice (twice the shared elements
    over both sizes). Elements are put in order of how few sets hold them; sets that are alike enough share one of
    their first few (the prefix filter) and have sizes alike (the length filter), so they meet by an equi-join on
    such a rare element, in the pair's first shared one alone. Equal sets meet once, as one, and come apart
    again in the result: only there does a group of n equal sets cost n * n rows, so give distinct sets.
    Empty and null sets are alike to nothing; repeated ids are taken as they are.
    """
    if measure not in ("jaccard", "dice"):
        raise ValueError(f"unknown measure: {measure}")
    keys = list(by)
    rows = rows.select(*keys, "id", F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items")).where(F.size("items") > 0)
    sets = rows.select(*keys, "items").distinct()
    held = sets.select(*keys, F.explode("items").alias("item")).groupBy(*keys, "item").agg(F.count("*").alias("times"))
    known = sets.withColumn("item", F.explode("items")).join(held, [*keys, "item"])
    ordered = known.groupBy(*keys, "items").agg(F.array_sort(F.collect_list(F.struct("times", "item"))).alias("rare"))
    n = F.size("items")
    first = F.slice(F.transform("rare", lambda x: x["item"]), 1, n - least_size(n, least, measure) + 1)
    side = ordered.select(*keys, "items", n.alias("n"), first.alias("first")).withColumn("item", F.explode("first"))
    other = side.select(*keys, "item", F.col("items").alias("items_"), F.col("n").alias("n_"), F.col("first").alias("first_"))
    met = side.join(other, [*keys, "item"]).where((F.col("n") <= F.col("n_")) & (F.col("n") >= least_size(F.col("n_"), least, measure)))
    met = met.where((F.col("items") <= F.col("items_")) | (F.col("n") < F.col("n_"))).where(F.array_intersect("first", "first_")[0] == F.col("item"))
    value = likeness(F.size(F.array_intersect("items", "items_")).cast("double"), F.col("n"), F.col("n_"), measure)
    alike = met.select(*keys, "items", "items_", value.alias("likeness")).where(F.col("likeness") >= least)
    a, b = rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b").withColumnRenamed("items", "items_")
    both = alike.join(a, [*keys, "items"]).join(b, [*keys, "items_"]).where((F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & (F.col("items") != F.col("items_"))))
    return both.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "likeness")
