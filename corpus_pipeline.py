"""A training corpus from raw documents: language identification, near-
duplicate removal, benchmark decontamination, mixing of sources, sharding.

Each stage takes the documents that its predecessor kept and gives documents
back, with the columns of ``documents`` (the last adds slot and shard).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm import decontam, langid, mixing, sharding, simhash
from veilgraph.plans.staging import staged
from veilgraph.plans.workers import reaching

#: A text whose languages are as good as equally likely is in none of them.
LEAST_SCORE = 0.3
SOURCE_WEIGHTS, MIX_RATIO, MAX_EPOCHS = [5.0, 2.0, 1.0], 1.5, 2.0


@reaching
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no learned language.

    Null and empty texts go; repeated rows are judged alike; without a
    labelled document every one goes; an empty table stays empty; very long
    texts are read whole; other columns go along.
    """
    net = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    found = langid.identify(docs, net)
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(sure).select(*docs.columns)


@reaching
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id (null
    last), of equal ids the first.

    Null and empty texts are near duplicates of each other; rows equal
    throughout are one group; an empty table stays empty; columns may have any
    name.
    """
    return simhash.keep_one(docs, radius=2)


@reaching
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark passages go.

    Null and empty texts are clean; repeated rows are judged each; an empty
    benchmark leaves all, an empty table stays empty; columns may have any
    name.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@reaching
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target wants them.

    Null and empty texts are repeated like their source; a null source is one;
    repeated rows are taken one by one; an empty table stays empty; columns
    named like the operator's own are replaced.
    """
    mixed = mixing.mix_sources(docs, SOURCE_WEIGHTS, total_ratio=MIX_RATIO, max_epochs=MAX_EPOCHS, seed=mixing.SEED)
    return mixing.materialize(mixed).select(*docs.columns)


@reaching
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's slot and shard.

    Null ids are placed by their text, repeated rows alike; an empty table
    stays empty; input columns slot and shard are replaced.
    """
    return sharding.assign_shards(docs, sharding.NAMES, seed=sharding.SEED)


STAGES = [
    ("language id", identify_language),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix),
    ("sharding", shard),
]

#: The first stage's network can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
