"""Deterministic samples, the three null policies of the annotation filter, ordinals and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import seeded_hash, strip
from .sections import in_order

SEED, AUTO_MODULUS, MANUAL_MODULUS = 33, 10_000, 100_000


def hash_sample(rows: DataFrame, seed: int = SEED, modulus: int = AUTO_MODULUS, column: str = "corpusid") -> DataFrame:
    """Whole papers whose hash is divisible by ``modulus``; a multiple of it gives a subset."""
    return rows.where(seeded_hash(seed, F.col(column)) % modulus == 0)


def _listed() -> Column:
    return F.col("sec_label_extended").isin(*V.NOT_ANNOTATED)


def annotatable_sqlnull(rows: DataFrame) -> DataFrame:
    """Text not blank, label not excluded; rows with a null label or text go."""
    return rows.where((strip("section_text") != "") & ~_listed())


def annotatable_pandas(rows: DataFrame) -> DataFrame:
    """The same, but rows with a null label or a null text stay."""
    return rows.where(F.coalesce(strip("section_text") != "", F.lit(True)) & ~F.coalesce(_listed(), F.lit(False)))


def annotatable_fillna(rows: DataFrame) -> DataFrame:
    """The same, but a null text reads as blank and goes while a null label stays."""
    return rows.where((strip(F.coalesce("section_text", F.lit(""))) != "") & ~F.coalesce(_listed(), F.lit(False)))


def section_ordinal(rows: DataFrame, name: str = "section_idx") -> DataFrame:
    """Index within the paper, from 0, in order of start."""
    return rows.withColumn(name, (F.row_number().over(in_order()) - 1).cast("bigint"))


def context_headers(rows: DataFrame, span: int = 5) -> DataFrame:
    """The headers before and after, nearest ``span`` each."""
    return rows.withColumn("previous_headers", F.collect_list("extracted").over(in_order().rowsBetween(-span, -1))).withColumn("next_headers", F.collect_list("extracted").over(in_order().rowsBetween(1, span)))


def ids_of(rows: DataFrame) -> Column:
    return F.concat_ws("-", F.col("corpusid"), F.col("section_idx"))


def random_choice(rows: DataFrame, n: int, seed: int, column: str) -> DataFrame:
    """n rows in a reproducible random order."""
    return rows.orderBy(seeded_hash(seed, F.col(column)), column).limit(n)


