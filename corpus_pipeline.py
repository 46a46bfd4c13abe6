"""A training-data pipeline over ``documents``: five stages, each one operator's decision on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concordat.llm._text import drop_tables, written
from concordat.llm.decontamination import uncontaminated
from concordat.llm.jaccard_join import first_of_groups
from concordat.llm.quality_classifier import accepted, train
from concordat.llm.source_mixing import mixed
from concordat.llm.suffix_dedup import without_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, brought in line with the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.selectExpr(*[f"cast(length(text) AS {kind.simpleString()}) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled input documents, accepts."""
    return accepted(docs, train(docs, _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least doc_id, of each group of near duplicates."""
    return first_of_groups(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that stand in an earlier place too."""
    return _sized(without_repeats(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return uncontaminated(docs, _table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in a mix of the sources at target weights, written in that order."""
    out = mixed(docs)
    return out.repartitionByRange("mix_position").sortWithinPartitions("mix_position")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("source_mix", source_mix),
]

#: SQL can't express the boosted model of the first stage, nor the schedule of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
            if k:
                drop_tables(spark, [before])
    return docs
