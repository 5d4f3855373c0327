"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
it kept, and returns a DataFrame; all but the last return the columns of docs.
The result of a stage is written as Parquet and read again by the next one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.jaccard_join import JaccardJoin, keep_one
from factloom.llm.language_id import UNKNOWN, LanguageIdentifier
from factloom.llm.packing import HilbertPacker
from factloom.llm.queries import every_line, mixture, word_bpe
from factloom.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reachable(stage: Stage) -> Stage:
    """Lets Python workers import this repository, wherever the driver runs."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent))
        return stage(spark, docs, sf_dir)

    return run_stage


@reachable
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language; fills in missing labels."""
    ident = LanguageIdentifier().fit(docs)
    if not ident.model.names:  # nothing is labelled: only texts without letters can be told
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = ident.annotate(docs)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (~F.col("lang_ambiguous") | (F.col("lang_score") >= 0.4)))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@reachable
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds; a document left without any
    line goes."""
    out = every_line().clean(docs).where("lines_kept > 0 or lines_dropped = 0")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@reachable
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, 0.8."""
    return keep_one(docs, JaccardJoin(shingle=5, percent=80))


@reachable
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents, some of them twice, to the target weights."""
    return mixture().select(docs, percent=100).select(*docs.columns)


@reachable
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of neighbouring documents, one row per piece."""
    return HilbertPacker(word_bpe(), length=2048, end_id=1).pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: SQL has no trained classifier and no tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name)
    return docs
