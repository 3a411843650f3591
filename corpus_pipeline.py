"""The corpus pipeline: quality rules, language, near-duplicates, mixing, packing. Each stage's table is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickframe.llm import langid, mixing, packing, quality, simhash
from tickframe.llm.common import released, scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps."""
    return quality.filter_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach, recognised with a score of LEAST_SCORE; a missing `lang` is filled in."""
    return langid.filter_documents(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("near-duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Packing and components can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other. Only the last stage's table stays: what a stage wrote for itself goes when the stage is
    done, its table when the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            done = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"), result=True)
        if i:
            released(docs)
        docs = done
    return docs
