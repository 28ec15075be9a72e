"""The document pipeline: raw documents to packed training sequences.

``STAGES`` lists (name, function) in order; a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last keep the columns of
documents. ``run`` applies them to a folder's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteflow.llm import langid, neardup, packing, toxicity
from graniteflow.llm.common import written

#: A text whose best language has a mean probability under this is in none of the learned languages.
LEAST_SCORE = 0.3


def whole(docs: DataFrame) -> DataFrame:
    """The columns that models read, and the row itself aside, so that columns that models add can't replace its own."""
    return docs.select("doc_id", "text", F.struct("*").alias("_row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay; null and letterless texts and texts like none of the languages go."""
    found = langid.identify(whole(docs), langid.train_on_fold(docs))
    return found.where((found["lang_pred"] != langid.UNKNOWN) & (found["score"] >= LEAST_SCORE)).select("_row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field takes for toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.score(whole(docs), toxicity.train_on_fold(docs, labels))
    return found.where("predicted = 0").select("_row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the least doc_id."""
    return neardup.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", distinct), ("packing", packed)]

#: Trained models decide here, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
