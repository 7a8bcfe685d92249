"""Text per (paper, label), its share of the paper, and the quality filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .ranks import nearest
from .sections import of_paper


def text_by_label(classified: DataFrame) -> DataFrame:
    """Texts of each (paper, label) joined by spaces in order of start; a null label is a group of its own."""
    parts = F.array_sort(F.collect_list(F.struct("start", "section_text")))
    text = F.array_join(F.transform(parts, lambda x: x["section_text"]), " ")
    return classified.groupBy("corpusid", "sec_label_extended").agg(text.alias("section_text"), F.min("start").alias("start"), F.max("paper_len").alias("paper_len"))


def length_by_label(classified: DataFrame) -> DataFrame:
    """What text_by_label gives, with ``section_length`` of the joined texts in place of these; from sections without texts."""
    joined = (F.sum("section_chars") + F.count(F.lit(1)) - 1).cast("bigint")
    return classified.groupBy("corpusid", "sec_label_extended").agg(joined.alias("section_length"), F.min("start").alias("start"), F.max("paper_len").alias("paper_len"))


def proportions(aggregated: DataFrame) -> DataFrame:
    """section_length, the paper's length without end matter, and the share in percent (null if that is 0)."""
    left_out = F.sum(F.when(F.col("sec_label_extended").isin(*V.NOT_LENGTH), F.col("section_length")).otherwise(0)).over(of_paper())
    sized = aggregated if "section_length" in aggregated.columns else aggregated.withColumn("section_length", F.length("section_text").cast("bigint"))
    out = sized.withColumn("adjusted_paper_len", F.col("paper_len") - left_out)
    share = F.try_divide(F.col("section_length").cast("double"), F.col("adjusted_paper_len").cast("double")) * 100
    return out.withColumn("perc_of_new_total", F.when(F.col("adjusted_paper_len") > 0, share))


def quality_filter(shares: DataFrame, min_sections: int = 2, max_section_perc: float = 80.0, cutoff_strategy: str = "fixed", iqr_multiplier: float = 0.25, percentile_cutoff: float = 0.75) -> DataFrame:
    """Relevant sections of papers with enough of them and none too large.

    The cutoffs of 'iqr' and 'percentile' depend on all papers given; they join as
    one row and never visit the driver.
    """
    relevant = shares.where(F.col("sec_label_extended").isin(*V.RELEVANT))
    rated = relevant.withColumn("n_sections", F.count(F.lit(1)).over(of_paper())).withColumn("max_perc", F.max("perc_of_new_total").over(of_paper()))
    if cutoff_strategy == "fixed":
        limited = rated.withColumn("cutoff", F.lit(float(max_section_perc)))
    else:
        top = relevant.groupBy("corpusid").agg(F.max("perc_of_new_total").alias("top"))
        if cutoff_strategy == "iqr":
            q = nearest(top, "top", (0.25, 0.75))
            cut = q.select(F.least(F.lit(100.0), F.col("q1") + F.lit(iqr_multiplier) * (F.col("q1") - F.col("q0"))).alias("cutoff"))
        elif cutoff_strategy == "percentile":
            cut = nearest(top, "top", (percentile_cutoff,)).select(F.col("q0").alias("cutoff"))
        else:
            raise ValueError(f"unknown cutoff strategy: {cutoff_strategy}")
        limited = rated.join(F.broadcast(cut))  # one row
    return limited.where((F.col("n_sections") >= min_sections) & (F.col("max_perc") <= F.col("cutoff"))).drop("n_sections", "max_perc", "cutoff")
