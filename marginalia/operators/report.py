"""A Markdown report of the cutoff analysis; only summaries of fixed size reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cutoffs import best_by_f1, nearest_to, stable_choice, summary


def table(df: DataFrame, most: int = 100, digits: int = 3) -> str:
    """The first ``most`` rows of a small frame as a Markdown table."""

    def cell(x: object) -> str:
        if x is None:
            return ""
        return f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")

    lines = [df.columns, ["---"] * len(df.columns), *([cell(x) for x in r] for r in df.limit(most).collect())]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def cutoff_report(metrics: DataFrame, grid: DataFrame) -> str:
    """Papers, quantiles of the longest section's share, and the cutoffs worth looking at."""
    papers = metrics.agg(F.count(F.lit(1)).alias("papers"), F.avg("n_sections").alias("mean_sections"), F.max("n_sections").alias("most_sections"))
    parts = [
        ("Papers", papers),
        ("Longest section, percent of the total", summary(metrics)),
        ("Stable choices", stable_choice(grid).orderBy("strategy", "min_sections")),
        ("Nearest to 80 percent", nearest_to(grid).orderBy("strategy", "min_sections")),
        ("Best by macro F1", best_by_f1(grid)),
    ]
    return "# Cutoff analysis\n" + "".join(f"\n## {title}\n\n{table(df)}\n" for title, df in parts)
