"""The corpus pipeline: stages over ``documents``, each calling one operator of ``shredkit.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shredkit.llm import decontaminate, mix, neardup, shard, toxicity
from shredkit.llm import oracles as llm_oracles
from shredkit.llm import queries as llm_queries
from shredkit.llm.frames import saved
from shredkit.llm.queries import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It is fitted on the labelled
    documents of this stage's input that are not held out."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.keep_one(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts so that sources have equal expected bytes."""
    return mix.mix_sources(docs).select(docs.columns)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its size, shard (0 to 7) and slot."""
    return shard.shard_by_bytes(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("sharding", shard_documents),
]

#: Trained scores, min-hash classes and alignments are beyond SQL; the stages are
#: tested against brute force and held-out labels in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each reads what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return llm_queries.queries() | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return llm_oracles.oracle_sql() | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
