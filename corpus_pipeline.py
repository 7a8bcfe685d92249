"""The corpus pipeline: quality, near-dedup, substring dedup, decontamination, mixture.

Each stage takes (spark, docs, sf_dir), works on all rows that it is given and
returns a DataFrame; the runner writes it as Parquet and reads it again as the
next stage's docs.  All stages but the last return the columns of ``documents``.
``n_chars`` is kept in step with the text.

Defined cases, beside those that each operator states for its own step: null
columns pass as they are; a null or empty text is judged by the classifier as an
empty one, is a near duplicate of all others without words, loses nothing and
leaks nothing; rows that repeat count as near duplicates, so one stays; an empty
table gives an empty result; columns beyond those of ``documents`` pass all
stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm._store import Kept, only
from marginalia.llm.decontaminate import drop_leaking
from marginalia.llm.mix_sources import mix_sources
from marginalia.llm.near_dedup import drop_near_duplicates
from marginalia.llm.quality import drop_low_quality
from marginalia.llm.substring_dedup import remove_repeated_words

#: SQL can't express the learned classifier, so the stages are tested one by one.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least 0.5; the others go."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least id."""
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words in repeated windows of 35 words; those that lose every word go."""
    out = remove_repeated_words(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's share in the mixture of sources: sizes, targets and the words taken."""
    return mix_sources(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result reads tables of the last stage; those of the stages before are deleted as soon as they have been used."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with only() as stay:
            stay.append(Kept(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before:
            before.drop()
        before = stay[0]
        docs = before.df
    out = STAGES[-1][1](spark, docs, sf_dir)
    before.drop()  # the mixture has written all it needs
    return out
