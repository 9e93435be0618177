"""The corpus pipeline: toxicity, quality rules, SimHash near-dedup, benchmark decontamination, packing.

Each stage works on all rows that the one before kept; STAGES may also be run one by
one, each on the written result of the one before.  All but the last return the columns of
``documents``.  The stage's models (toxicity, quality) are fitted on the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ohmwatch.llm import decontamination, packing, quality, simhash, toxicity
from ohmwatch.llm.arrays import stored
from ohmwatch.llm.queries import table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_one_copy),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL cannot express a learned classifier, EM or the vocabulary's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
