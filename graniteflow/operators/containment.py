"""Texts that stand inside other texts, by an index of two-letter grams instead of all against all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, size: int) -> Column:
    """The distinct stretches of ``size`` letters."""
    n = F.char_length(text)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def contained(parts: DataFrame, wholes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (by..., part, whole): texts ``part`` of parts that stand in texts ``whole`` of wholes, with equal columns ``by``.

    Texts are made distinct first. A part meets the wholes that hold its rarest pair of letters, the first of the rarest; parts of
    one letter meet by that. So a gram that most wholes hold is joined on only by parts that have no rarer one.
    Null and empty texts stand in nothing and hold nothing; nulls in ``by`` equal nothing. Case counts.
    Joins are by merging: the sizes of exploded rows are guessed too low, and a side taken for small would be sent to the driver.
    """
    keys = list(by)
    short = parts.where("part != ''").select(*keys, "part").distinct()
    long = wholes.where("whole != ''").select(*keys, "whole").distinct()
    ones = short.where("char_length(part) = 1").select(*keys, "part", F.col("part").alias("gram"))
    index = long.select(*keys, "whole", F.explode(F.array_union(grams(F.col("whole"), 2), grams(F.col("whole"), 1))).alias("gram"))
    held = index.groupBy(*keys, "gram").agg(F.count("*").alias("times"))
    pairs = short.where("char_length(part) > 1").select(*keys, "part", F.explode(grams(F.col("part"), 2)).alias("gram"))
    # a gram that no whole holds ends the part: nothing holds it
    rarest = pairs.join(held.hint("merge"), [*keys, "gram"], "left").groupBy(*keys, "part").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram")).alias("least"))
    asked = rarest.where("least.times > 0").select(*keys, "part", F.col("least.gram").alias("gram")).unionByName(ones)
    return asked.join(index.hint("merge"), [*keys, "gram"]).where(F.contains("whole", "part")).select(*keys, "part", "whole")
