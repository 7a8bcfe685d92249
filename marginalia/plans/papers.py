"""A papers view over ``documents``: each line gets a header, so that section rules have something to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS = (
    "1. Introduction", "Background", "2. Related Work", "Materials and Methods", "3. Our Framework", "Statistical Analysis",
    "IV. Results", "Results and Discussion", "Results and discussions", "Figure 1", "Table 2", "Discussion", "Limitations",
    "V. Conclusion", "Future directions", "Acknowledgments", "Funding", "References", "Appendix A", "Data availability statement",
    "Case presentation", "A Topological View", "State-of-the-art", "  Observed effects  ",
)


def papers_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpusid, text, sectionheader): lang, then header and line alternating, one per line of text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("corpusid"), "lang", F.split("text", "\n").alias("lines"))
    names = F.array(*[F.lit(h) for h in HEADERS])
    item = F.transform("lines", lambda line, i: F.struct(i.alias("i"), names[F.pmod(F.col("corpusid") * 13 + i * 11, F.lit(24)).cast("int")].alias("h"), line.alias("line")))
    # where each header starts: sums over the sizes of the lines before (zipped in, as a lambda would compute them anew for each line)
    size = F.transform(item, lambda x: (F.length(x["h"]) + F.length(x["line"]) + 2).cast("bigint"))
    starts = F.aggregate(size, F.array((F.length("lang") + 1).cast("bigint")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    d = d.select("corpusid", "lang", item.alias("items"), starts.alias("starts"))

    def header(x, at):
        n = F.when(x["i"] % 3 == 0, F.concat((x["i"] + 1).cast("string"), F.lit("."))).when(x["i"] % 3 == 1, F.concat(x["i"].cast("string"), F.lit(".1")))
        return F.struct(at.alias("start"), (at + F.length(x["h"])).alias("end"), F.struct(n.alias("n")).alias("attributes"))

    text = F.concat("lang", F.lit("\n"), F.array_join(F.transform("items", lambda x: F.concat(x["h"], F.lit("\n"), x["line"], F.lit("\n"))), ""))
    return d.select("corpusid", text.alias("text"), F.zip_with("items", F.slice("starts", 1, F.size("items")), header).alias("sectionheader"))


_LIST = ", ".join("'" + h.replace("'", "''") + "'" for h in HEADERS)

#: The same in SQL, as the first common table expressions of an oracle: ``papers`` and ``heads``.
PAPERS_SQL = f"""
src AS (SELECT doc_id AS corpusid, lang, string_split(text, chr(10)) AS lines FROM documents),
ln AS (SELECT corpusid, lang, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM src),
hd AS (SELECT *, [{_LIST}][CAST((corpusid * 13 + i * 11) % 24 AS INT) + 1] AS header FROM ln),
heads AS (SELECT corpusid, i, header, line,
  CAST(length(lang) + 1 + coalesce(sum(length(header) + length(line) + 2) OVER (PARTITION BY corpusid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  CASE i % 3 WHEN 0 THEN (i + 1) || '.' WHEN 1 THEN i || '.1' END AS section_n FROM hd),
papers AS (SELECT corpusid, any_value(lang) || chr(10) || string_agg(header || chr(10) || line || chr(10), '' ORDER BY i) AS text FROM hd GROUP BY corpusid)"""
