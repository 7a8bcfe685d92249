"""From a folder of papers to classified, aggregated and filtered sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import aggregate, sections
from ..sources.files import read_papers, write_parquet

OUTPUTS = ("classified", "aggregated", "filtered")


def run(
    spark: SparkSession, source: str, out: str, n_rows: int | None = None, min_sections: int = 2, max_section_perc: float = 80.0,
    cutoff_strategy: str = "fixed", iqr_multiplier: float = 0.25, percentile_cutoff: float = 0.75, max_rows: int | None = None,
) -> dict[str, DataFrame]:
    """Writes ``classified.parquet``, ``aggregated.parquet`` and ``filtered.parquet`` under ``out``; returns them read again.

    Each step reads what the one before has written, so a failure costs one step.
    ``n_rows`` limits a trial run; the others are those of ``quality_filter``.
    """
    paths = {x: f"{out.rstrip('/')}/{x}.parquet" for x in OUTPUTS}
    write_parquet(sections.classify(read_papers(spark, source, n_rows)), paths["classified"], max_rows)
    write_parquet(aggregate.proportions(aggregate.text_by_label(spark.read.parquet(paths["classified"]))), paths["aggregated"], max_rows)
    kept = aggregate.quality_filter(spark.read.parquet(paths["aggregated"]), min_sections, max_section_perc, cutoff_strategy, iqr_multiplier, percentile_cutoff)
    write_parquet(kept, paths["filtered"], max_rows)
    return {x: spark.read.parquet(p) for x, p in paths.items()}
