"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import decontaminate, dedup, mixing, neardup, quality
from starloom.llm.scratch import dropped, without, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Rows go by id and text together, so a repeated row shares its fate; null and empty texts are scored like others; a null id is an
    id. Columns of any name stay as they are.
    """
    judged = quality.quality(docs, _table(spark, sf_dir, "labels"))
    return without(docs, judged.where(~F.col("accepted")).select(F.col("doc_id").alias("id"), "key"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest original, then the smallest doc_id (null last).

    Null counts as empty, and all texts of white space alone are one group. Of rows repeated whole one stays. Columns of
    any name stay as they are.
    """
    return dedup.exact_dedup(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id.

    Texts without words are linked with nothing and stay; so do rows of a group that share the smallest id. A row with a
    null id stays only where it links with no row that has one. Columns of any name stay as they are.
    """
    found = neardup.jaccard_components(docs)
    return without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id"), "key"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go.

    Null and empty texts share none; repeated rows go together; an empty benchmark takes nothing. Columns of any name stay.
    """
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated").select(F.col("doc_id").alias("id"), "key"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents taken at least once, with copies, size, taken and their source's size and target.

    A null source is a source (the last). Documents without words cost nothing and are held to the cap; rows that share id,
    source and size share a decision. Where a column has a made column's name, the made one is called mix_NAME.
    """
    return mixing.taken_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
]

#: A fitted classifier is not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole table of documents. A stage's table goes once the next one's is written, so one copy is kept."""
    docs = _table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
