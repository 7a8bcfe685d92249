"""From papers to labelled sections.

``papers`` is one row per document: corpusid, text, sectionheader (array of
{start, end, attributes{n}}).  corpusid must be unique.  Sections are cut from
the text inside the paper's row, before the headers are exploded, so the text is
never joined back, and one exchange on corpusid serves all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import vocabulary as V
from ..functions.text import code_point_slice, strip


def in_order() -> WindowSpec:
    """A paper's sections by start."""
    return Window.partitionBy("corpusid").orderBy("start")


def of_paper() -> WindowSpec:
    return Window.partitionBy("corpusid")


REQUIRED = ("corpusid", "text", "sectionheader")


def validate(papers: DataFrame, required: tuple[str, ...] = REQUIRED) -> None:
    missing = set(required) - set(papers.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")


def duplicate_papers(papers: DataFrame) -> DataFrame:
    """corpusids that occur more than once (there must be none)."""
    return papers.groupBy("corpusid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def headers_in_order(headers: Column) -> Column:
    """(start, pos, end_header, section_n) sorted by start; of equal starts the first in the array."""
    entries = F.transform(
        headers,
        lambda h, i: F.struct(
            h["start"].cast("bigint").alias("start"),
            i.alias("pos"),
            h["end"].cast("bigint").alias("end_header"),
            h["attributes"]["n"].alias("section_n"),
        ),
    )
    entries = F.array_sort(F.filter(entries, lambda e: e["start"].isNotNull()))
    shifted = F.concat(F.array(F.lit(None).cast("bigint")), entries["start"])
    paired = F.filter(F.zip_with(entries, shifted, lambda e, p: F.struct(e.alias("e"), p.alias("p"))), lambda x: x["e"].isNotNull())
    return F.filter(paired, lambda x: x["p"].isNull() | (x["p"] != x["e"]["start"]))["e"]


def header_extraction(papers: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per header: offsets, header text, list marker and normalised header.

    A section runs from its header's start to the next header's start, the last
    to the end of the text; a header beyond the end is dropped.  Without texts
    ``section_chars`` says how long each one is.
    """
    p = papers.select("corpusid", "text", F.length("text").cast("bigint").alias("paper_len"), headers_in_order(F.col("sectionheader")).alias("h"))
    following = F.slice(F.col("h")["start"], F.lit(2), F.greatest(F.size("h"), F.lit(1)))

    def cut(h: Column, nxt: Column) -> Column:
        end = F.coalesce(nxt, F.col("paper_len"))
        fields = [h["start"].alias("start"), h["end_header"].alias("end_header"), h["section_n"].alias("section_n"), end.alias("end_section")]
        fields.append(code_point_slice(F.col("text"), h["start"], h["end_header"]).alias("txt_header"))
        if with_text:
            fields.append(code_point_slice(F.col("text"), h["start"], end).alias("section_text"))
        else:
            inside = F.greatest(F.least(end, F.col("paper_len")) - h["start"], F.lit(0))
            fields.append(F.when(h["start"] >= 0, inside).otherwise(F.length(code_point_slice(F.col("text"), h["start"], end))).cast("bigint").alias("section_chars"))
        return F.struct(*fields)

    rows = p.select("corpusid", "paper_len", F.explode(F.when(F.col("text").isNotNull(), F.zip_with("h", following, cut))).alias("s")).select("corpusid", "paper_len", "s.*")
    rows = rows.where("end_section >= start")
    marker = F.nullif(F.regexp_extract("txt_header", "(?U)" + V.LIST_MARKER, 1), F.lit(""))
    plain = F.lower(strip(F.regexp_replace("txt_header", "(?U)" + V.LIST_MARKER, "")))
    return rows.withColumn("section_number", marker).withColumn("extracted", plain)


def exact_label(extracted: Column) -> Column:
    out = None
    for label, phrases in V.PHRASES.items():
        out = (F if out is None else out).when(extracted.isin(*sorted(phrases)), label)
    return out


def pattern_label(extracted: Column) -> Column:
    out = None
    for label, inner in V.PATTERNS:
        out = (F if out is None else out).when(extracted.rlike("(?U)" + V.word_pattern(inner)), label)
    return out


def alternative_label(extracted: Column) -> Column:
    out = None
    for label, phrases in V.ALTERNATIVES.items():
        out = (F if out is None else out).when(extracted.isin(*sorted(phrases)), label)
    return out


def initial_mapping(sections: DataFrame) -> DataFrame:
    e = F.col("extracted")
    return sections.withColumn("section_alt_label", alternative_label(e)).withColumn("sec_map", F.coalesce(exact_label(e), pattern_label(e)))


def last_core_start() -> Column:
    return F.coalesce(F.max(F.when(F.col("sec_map").isin(*V.CORE), F.col("start"))).over(of_paper()), F.lit(0))


def end_matter(sections: DataFrame) -> DataFrame:
    """Labels outside the core count only behind the last core header."""
    keep = F.col("sec_map").isin(*V.CORE) | (F.col("start") > F.col("last_core_start"))
    return sections.withColumn("last_core_start", last_core_start()).withColumn("sec_label", F.when(keep, F.col("sec_map"))).drop("last_core_start")


def top_header() -> Column:
    top = F.col("section_n").rlike("(?U)" + V.TOP_NUMBER + r"\z") | F.col("section_number").rlike("(?U)" + V.TOP_ROMAN + r"\z") | F.col("sec_map").isin(*V.CORE)
    return F.coalesce(top, F.lit(False))


def development(sections: DataFrame) -> DataFrame:
    """An unlabelled top-level header right behind introduction or related work starts the development."""
    before = F.lag("sec_label").over(in_order())
    is_dev = F.col("sec_label").isNull() & F.col("top_header") & before.isin("introduction", "lit_review")
    return sections.withColumn("top_header", top_header()).withColumn("sec_label_new", F.when(is_dev, "development").otherwise(F.col("sec_label")))


def forward_fill(sections: DataFrame) -> DataFrame:
    fill = F.last("sec_label_new", ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sections.withColumn("sec_label_extended", fill)


def classify(papers: DataFrame, with_text: bool = True) -> DataFrame:
    """All labelling steps; one row per section.

    With texts the papers are dealt by corpusid before they are cut: the one
    exchange that the windows need then moves each text once, without the columns
    of its sections.  Without texts it moves the headers' rows instead.
    """
    validate(papers)
    if with_text:
        papers = papers.select(*REQUIRED).repartition("corpusid")
    return forward_fill(development(end_matter(initial_mapping(header_extraction(papers, with_text)))))
