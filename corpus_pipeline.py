"""Quality rules, near-duplicates, decontamination, mixing and sharding, one after another over `documents`.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of documents; the last adds each
row's shard and slot. What a stage returns is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradewind.llm import decontaminate, host_rules, mixing, reshard, simhash
from tradewind.llm.store import materialize, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = mixing.domain_labels(read_table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, labelled, mixing.TARGETS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reshard.reshard(docs, stored=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("sharding", sharding),
]

#: The stages hash words with functions that SQL lacks; tests/llm/test_queries.py holds each stage and run() against the queries, and these against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
