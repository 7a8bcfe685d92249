"""Cutoff analysis: paper metrics, thresholds, the grid over them, stable choices and plot data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .evaluation import averages, label_counts
from .ranks import cumulative, linear

IQR_STEPS = tuple(k / 4 for k in range(13))
PERCENTILES = tuple(p / 10 for p in range(500, 951, 25)) + (96.0, 97.0, 98.0, 99.0)


def paper_metrics(shares: DataFrame) -> DataFrame:
    """Total, longest and number of relevant sections and the longest one's share of the total in percent."""
    g = shares.where(F.col("sec_label_extended").isin(*V.RELEVANT)).groupBy("corpusid")
    m = g.agg(F.sum("section_length").alias("total_section_length"), F.max("section_length").alias("longest_section_length"), F.count("section_length").alias("n_sections"))
    share = F.try_divide(F.col("longest_section_length").cast("double"), F.col("total_section_length").cast("double")) * 100
    return m.withColumn("longest_section_percent", share)


def thresholds(metrics: DataFrame, column: str = "longest_section_percent", digits: int = 9) -> DataFrame:
    """(strategy, parameter, threshold): IQR fences and percentiles (linear), clipped to 0..100.

    A threshold that repeats within its strategy keeps its first parameter.
    """
    at = [25.0, 75.0, *PERCENTILES]
    q = linear(metrics, column, [p / 100 for p in at])
    fence = [F.struct(F.lit("iqr").alias("strategy"), F.lit(k).alias("parameter"), F.least(F.lit(100.0), F.col("q")[1] + F.lit(k) * (F.col("q")[1] - F.col("q")[0])).alias("threshold")) for k in IQR_STEPS]
    cuts = [F.struct(F.lit("percentile").alias("strategy"), F.lit(p).alias("parameter"), F.col("q")[i + 2].alias("threshold")) for i, p in enumerate(PERCENTILES)]
    rows = q.where("q is not null").select(F.explode(F.array(*fence, *cuts)).alias("t")).select("t.*")
    rows = rows.withColumn("threshold", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), "threshold")), digits))
    return rows.groupBy("strategy", "threshold").agg(F.min("parameter").alias("parameter")).select("strategy", "parameter", "threshold")


def threshold_grid(cuts: DataFrame, metrics: DataFrame, eval_rows: DataFrame, min_sections: Sequence[int] = (2, 3), labels: Sequence[str] = V.RELEVANT) -> DataFrame:
    """Retention and F1 at each (strategy, threshold, min_sections).

    Each paper is placed once among each strategy's sorted thresholds: those from
    its place on keep it.  Papers and evaluation rows are counted per place and
    number of sections, and only these few counts meet the grid.
    eval_rows: (corpusid, true_label, pred_label).
    """
    grid = cuts.join(F.broadcast(cuts.sparkSession.createDataFrame([(m,) for m in min_sections], "min_sections int")))
    key = ["strategy", "parameter", "threshold", "min_sections"]
    steps = cuts.groupBy("strategy").agg(F.array_sort(F.collect_set("threshold")).alias("steps"))  # a fixed number of cutoffs
    percent = F.round("longest_section_percent", 9)
    keeps = F.try_element_at(F.filter("steps", lambda t: t >= percent), F.lit(1)).alias("place")  # the lowest threshold that keeps it
    sections = F.least("n_sections", F.lit(max(min_sections)).cast("bigint")).alias("sections")
    placed = metrics.select("corpusid", sections, "longest_section_percent").join(F.broadcast(steps)).select("corpusid", "strategy", "sections", keeps).where("place is not null")

    def kept(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """Counts per (strategy, place, sections) summed over what each cell of the grid keeps."""
        names = [c for c in counts.columns if c not in ("strategy", "place", "sections", *by)]
        cells = counts.join(F.broadcast(grid), "strategy").where("sections >= min_sections and place <= threshold")
        return cells.groupBy(*key, *by).agg(*[F.sum(c).alias(c) for c in names])

    total = metrics.agg(F.count(F.lit(1)).alias("all_papers"))
    where = ["strategy", "place", "sections"]
    papers = kept(placed.groupBy(*where).agg(F.count(F.lit(1)).alias("retained_papers")))
    cells = eval_rows.groupBy("corpusid", "true_label", "pred_label").agg(F.count(F.lit(1)).alias("k")).join(placed, "corpusid")
    pairs = kept(cells.groupBy(*where, "true_label", "pred_label").agg(F.sum("k").alias("k")), ("true_label", "pred_label"))
    rated = cells.groupBy("corpusid", *where).agg(F.sum("k").alias("eval_sections")).groupBy(*where).agg(F.count(F.lit(1)).alias("eval_papers"), F.sum("eval_sections").alias("eval_sections"))
    f1 = averages(label_counts(pairs, "true_label", "pred_label", key, "k"), labels, key)
    out = grid.join(papers, key, "left").join(kept(rated), key, "left").join(f1, key, "left").join(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*key, zero("retained_papers"), F.try_divide(F.coalesce("retained_papers", F.lit(0)).cast("double"), F.col("all_papers").cast("double")).alias("retention_rate"), zero("eval_papers"), zero("eval_sections"), "macro_f1", "weighted_f1")


def stable_choice(grid: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per (strategy, min_sections): of the rows within ``tolerance`` of the best macro F1 the one that keeps most, then the highest threshold."""
    part = Window.partitionBy("strategy", "min_sections")
    close = grid.withColumn("best", F.max("macro_f1").over(part)).where(F.round("macro_f1", 9) >= F.round(F.col("best") - tolerance, 9))
    rn = F.row_number().over(part.orderBy(F.desc("retained_papers"), F.desc("threshold")))
    return close.withColumn("rn", rn).where("rn = 1").drop("rn", "best")


def nearest_to(grid: DataFrame, target: float = 80.0) -> DataFrame:
    """The row of each (strategy, min_sections) whose threshold is nearest to the target."""
    rn = F.row_number().over(Window.partitionBy("strategy", "min_sections").orderBy(F.round(F.abs(F.col("threshold") - target), 6), "threshold"))
    return grid.withColumn("rn", rn).where("rn = 1").drop("rn")


def best_by_f1(grid: DataFrame, n: int = 10) -> DataFrame:
    """The n rows of the grid with the highest macro F1; of equal ones those that keep most papers."""
    return grid.orderBy(F.desc_nulls_last(F.round("macro_f1", 6)), F.desc("retained_papers"), "strategy", "min_sections", F.round("threshold", 6)).limit(n)


def human_eval_rows(majority: DataFrame, positions: DataFrame, classified: DataFrame, metrics: DataFrame, labels: Sequence[str] = V.RELEVANT) -> DataFrame:
    """Majority labels beside the classifier's, with the paper's metrics; rows whose labels are both in ``labels``.

    majority: (paper_id, section_idx, consensus); positions: (paper_id,
    section_idx, start); classified: (corpusid, start, sec_label_extended).
    """
    placed = majority.join(positions, ["paper_id", "section_idx"], "left")
    rows = placed.join(classified.select(F.col("corpusid").alias("paper_id"), "start", F.col("sec_label_extended").alias("pred_label")), ["paper_id", "start"])
    rows = rows.where(F.col("consensus").isin(*labels) & F.col("pred_label").isin(*labels))
    return rows.join(metrics.withColumnRenamed("corpusid", "paper_id"), "paper_id", "left").withColumnRenamed("consensus", "true_label")


def ecdf(values: DataFrame, column: str) -> DataFrame:
    """(value, share): for each value the share of rows up to its last occurrence; one row per distinct value."""
    return cumulative(values, column).select(F.col("v").alias("value"), (F.col("upto") / F.col("total")).alias("share"))


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int = 60) -> DataFrame:
    """Counts in equal bins from ``low`` to ``high``; the last is closed on the right."""
    v = values.where(F.col(column).between(low, high))
    b = F.least(F.floor((F.col(column) - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return v.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def retained_by_count(metrics: DataFrame, column: str = "n_sections") -> DataFrame:
    """(k, share): the share of papers with at least k sections, k from 1 to the largest count."""
    n = metrics.groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.max("k").alias("top"))
    ks = total.select("total", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("top").cast("bigint"))).alias("at"))
    return ks.join(F.broadcast(n), F.col("k") >= F.col("at")).groupBy("at", "total").agg(F.sum("n").alias("kept")).select(F.col("at").alias("k"), (F.col("kept") / F.col("total")).alias("share"))


def summary(metrics: DataFrame, column: str = "longest_section_percent") -> DataFrame:
    g = metrics.agg(F.avg((F.col("n_sections") >= 2).cast("int")).alias("share_2"), F.avg((F.col("n_sections") >= 3).cast("int")).alias("share_3"))
    g = linear(metrics, column, (0.5, 0.75, 0.9, 0.95, 0.99)).join(F.broadcast(g))
    return g.select(*[F.col("q")[i].alias(x) for i, x in enumerate(("median", "p75", "p90", "p95", "p99"))], "share_2", "share_3")
