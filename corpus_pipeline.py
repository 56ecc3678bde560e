"""A training-data pipeline over `documents`: toxicity, near-dedup, decontamination, sanitisation, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages are
written as Parquet in between. Counted as part of the subpackage weirstream.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstream.llm import decontaminate, minhash_dedup, mixing, pii, toxicity
from weirstream.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; it learns from the training labels of these documents."""
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    bad = materialise(scored.where("predicted = 1").select(F.col("doc_id").alias("bad_id")).distinct(), "toxic")
    return docs.join(bad, docs["doc_id"] == bad["bad_id"], "left_anti")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates stays."""
    return minhash_dedup.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("sanitisation", sanitise),
    ("mixing", mix),
]
#: Viterbi decoding and a fitted classifier have no SQL; tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
