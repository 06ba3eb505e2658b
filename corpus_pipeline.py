"""From raw documents to training shards: every stage works on what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it again, so that a lost executor costs no more than a stage.

All columns of ``documents`` are kept, whatever their names; null ids are ids like others, and an empty table goes
through all stages as one.  What each stage does with null and empty texts and with repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import decontamination, minhash, mixing, sharding, toxicity
from wordloom.llm.common import arrow_bounded
from wordloom.session import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay.

    A null text scores as an empty one, and equal texts score alike, so repeated rows stay or go together.
    """
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    arrow_bounded(spark)
    return docs.filter(model.score(F.col("text")) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and one of rows alike in id and text.

    Texts without words, null ones among them, are like no other and stay.
    """
    return minhash.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    A null or empty text has no words and stays; repeated rows stay or go together.  With an empty benchmark all stay.
    """
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Sizes are words, so null and empty texts weigh nothing; repeated rows count one by one.
    """
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it.

    Equal texts share a shard unless they are larger than one; null texts are equal to each other, and empty ones
    too.  Repeated rows have places of their own.
    """
    return sharding.sharded(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("shard", assign_shards),
]

# Two stages learn or sample by hashes that SQL does not have: tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
