"""One query per operator over the tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import aggregate as G
from ..operators import annotations as A
from ..operators import batches as B
from ..operators import cutoffs as C
from ..operators import demographics as D
from ..operators import evaluation as E
from ..operators import sampling as P
from ..operators import sections as S
from ..sources.files import stored
from .papers import PAPERS_SQL, papers_view
from .section_sql import AGGREGATED_SQL, CLASSIFIED_SQL, HEADERS_SQL, LABELS_SQL, with_

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _labels(labels) -> str:
    return "(" + ", ".join(f"'{x}'" for x in labels) + ")"


def classified(spark: SparkSession, sf: str, with_text: bool = True) -> DataFrame:
    return S.classify(papers_view(spark, sf), with_text)


def mapped(spark: SparkSession, sf: str) -> DataFrame:
    return S.initial_mapping(S.header_extraction(papers_view(spark, sf), with_text=False))


def shares(spark: SparkSession, sf: str) -> DataFrame:
    return G.proportions(G.text_by_label(classified(spark, sf)))


def lengths(spark: SparkSession, sf: str, c: DataFrame | None = None) -> DataFrame:
    """The shares without texts, which metrics don't need; c: the classified sections, where they are at hand."""
    return G.proportions(G.length_by_label(classified(spark, sf, with_text=False) if c is None else c))


def heads(spark: SparkSession, sf: str) -> DataFrame:
    p = papers_view(spark, sf).select("corpusid", F.posexplode("sectionheader").alias("pos", "h"))
    return p.select("corpusid", F.col("pos").cast("bigint").alias("i"), F.col("h.start").alias("start"))


def pick(k: Column, labels=V.ANNOTATOR) -> Column:
    return F.array(*[F.lit(x) for x in labels])[F.pmod(k, F.lit(len(labels))).cast("int")]


_PICK = "[" + ", ".join(f"'{x}'" for x in V.ANNOTATOR) + "]"


def votes(spark: SparkSession, sf: str, h: DataFrame | None = None) -> DataFrame:
    """Derived human votes: four annotators of which the first does not qualify, some votes missing; h: the heads, where they are at hand."""
    h = (heads(spark, sf) if h is None else h).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("a"))
    h = h.where((F.col("corpusid") + F.col("i") + F.col("a")) % 5 != 0)
    label = pick(F.col("corpusid") * 7 + F.col("i") * 3 + F.col("a") * (F.col("i") % 4))
    out = h.select(
        F.col("corpusid").alias("paper_id"), F.col("i").alias("section_idx"), "start", (F.col("a") + 68).cast("bigint").alias("annotator_id"), label.alias("label"),
        (F.col("corpusid") % 37 == 0).alias("is_other_language"), ((F.col("corpusid") + F.col("i")) % 29 == 0).alias("is_annotator_confused"),
    )
    return out


VOTES_SQL = f"""{PAPERS_SQL},
votes AS (SELECT corpusid AS paper_id, i AS section_idx, start, CAST(68 + a AS BIGINT) AS annotator_id, {_PICK}[CAST((corpusid * 7 + i * 3 + a * (i % 4)) % 10 AS INT) + 1] AS label,
  corpusid % 37 = 0 AS is_other_language, (corpusid + i) % 29 = 0 AS is_annotator_confused FROM heads, range(0, 4) t(a) WHERE (corpusid + i + a) % 5 <> 0),
valid AS (SELECT * FROM votes WHERE annotator_id >= 69 AND NOT is_other_language AND NOT is_annotator_confused AND label IS NOT NULL)"""


def valid_votes(spark: SparkSession, sf: str, h: DataFrame | None = None) -> DataFrame:
    return votes(spark, sf, h).where("annotator_id >= 69 and not is_other_language and not is_annotator_confused and label is not null")


def llm_runs(spark: SparkSession, sf: str, h: DataFrame | None = None) -> DataFrame:
    h = (heads(spark, sf) if h is None else h).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r"))
    label = pick(F.col("corpusid") * 7 + F.col("i") * 3 + F.col("r") * (F.col("i") % 3))
    return h.select(F.col("corpusid").alias("paper_id"), F.col("i").alias("section_idx"), "start", F.concat(F.lit("run"), F.col("r")).alias("run_id"), label.alias("label"))


LLM_SQL = f"""llm AS (SELECT corpusid AS paper_id, i AS section_idx, start, 'run' || r AS run_id, {_PICK}[CAST((corpusid * 7 + i * 3 + r * (i % 3)) % 10 AS INT) + 1] AS label
  FROM heads, range(0, 3) t(r))"""

_TOP_SQL = "top AS (SELECT paper_id, section_idx, label, count(*) AS n, row_number() OVER (PARTITION BY paper_id, section_idx ORDER BY count(*) DESC, label) AS rn FROM llm GROUP BY paper_id, section_idx, label)"
_MAJORITY_SQL = """counts AS (SELECT paper_id, section_idx, label, count(*) AS votes, sum(count(*)) OVER (PARTITION BY paper_id, section_idx) AS total FROM valid GROUP BY paper_id, section_idx, label),
majority AS (SELECT paper_id, section_idx, label AS consensus FROM counts WHERE votes * 2 > total)"""


def wide(spark: SparkSession, sf: str, llm: bool = True, c: DataFrame | None = None) -> DataFrame:
    """corpusid, i, start with the labels of the classifier, the language model (if asked for) and the human majority; c: the classified sections, where they are at hand."""
    c = (classified(spark, sf, with_text=False) if c is None else c).select("corpusid", "start", F.col("sec_label_extended").alias("classification_label"))
    places = stored(heads(spark, sf))  # used for each rater
    h = places.join(c, ["corpusid", "start"], "left")
    item = [F.col("corpusid").alias("paper_id"), F.col("i").alias("section_idx")]
    out = h.select(*item, "start", "classification_label")
    if llm:
        runs = llm_runs(spark, sf, places)
        out = out.join(E.top_label(runs).select("paper_id", "section_idx", F.col("label").alias("llm_label")), list(E.ITEM), "left")
    human = E.majority(valid_votes(spark, sf, places)).select("paper_id", "section_idx", F.col("consensus").alias("manual_label"))
    return out.join(human, list(E.ITEM), "left")


WIDE_SQL = f"""{CLASSIFIED_SQL},
{VOTES_SQL[len(PAPERS_SQL) + 2 :]},
{LLM_SQL},
{_TOP_SQL},
{_MAJORITY_SQL},
wide AS (SELECT h.corpusid AS paper_id, h.i AS section_idx, h.start, c.sec_label_extended AS classification_label, t.label AS llm_label, m.consensus AS manual_label
  FROM heads h LEFT JOIN classified c USING (corpusid, start) LEFT JOIN top t ON t.paper_id = h.corpusid AND t.section_idx = h.i AND t.rn = 1
  LEFT JOIN majority m ON m.paper_id = h.corpusid AND m.section_idx = h.i)"""


def metric_pairs(spark: SparkSession, sf: str, c: DataFrame | None = None) -> DataFrame:
    w = wide(spark, sf, llm=False, c=c).where("classification_label is not null and manual_label is not null")
    return w.where(F.col("classification_label").isin(*V.RELEVANT) & F.col("manual_label").isin(*V.RELEVANT)).select(F.col("paper_id").alias("corpusid"), F.col("manual_label").alias("true_label"), F.col("classification_label").alias("pred_label"))


PAIRS_SQL = f"""{WIDE_SQL},
pairs AS (SELECT paper_id AS corpusid, manual_label AS true_label, classification_label AS pred_label FROM wide WHERE classification_label IN {_labels(V.RELEVANT)} AND manual_label IN {_labels(V.RELEVANT)}),
roles AS (SELECT true_label AS label, (true_label = pred_label)::BIGINT AS tp, 0 AS fp, (true_label <> pred_label)::BIGINT AS fn FROM pairs
  UNION ALL SELECT pred_label, 0, (true_label <> pred_label)::BIGINT, 0 FROM pairs),
prf AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tp) + sum(fn) AS support,
  coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0)::DOUBLE AS precision, coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0)::DOUBLE AS recall,
  coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0)::DOUBLE AS f1 FROM roles GROUP BY label)"""


def r6(*cols: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in cols]


# --- headers and labels -----------------------------------------------------------------------


@query(with_(LABELS_SQL, "SELECT sec_map AS label, count(*) AS n FROM mapped GROUP BY 1"))
def section_label_counts(spark, sf):
    return mapped(spark, sf).groupBy(F.col("sec_map").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(with_(HEADERS_SQL, "SELECT corpusid, start, end_header, section_n, end_section, paper_len, txt_header, section_number, extracted FROM sec"))
def header_extraction(spark, sf):
    return S.header_extraction(papers_view(spark, sf), with_text=False).select("corpusid", "start", "end_header", "section_n", "end_section", "paper_len", "txt_header", "section_number", "extracted")


@query(with_(HEADERS_SQL, "SELECT corpusid, start, end_section, paper_len FROM bounds WHERE end_section >= start"))
def section_boundaries(spark, sf):
    return S.header_extraction(papers_view(spark, sf), with_text=False).select("corpusid", "start", "end_section", "paper_len")


@query(with_(PAPERS_SQL, "SELECT corpusid, start, CAST(start + length(header) AS BIGINT) AS end_header FROM heads"))
def dedupe_first(spark, sf):
    """Every header twice, the second time with another end: the first in the array stays."""
    twice = F.concat("sectionheader", F.transform("sectionheader", lambda h: F.struct(h["start"].alias("start"), (h["end"] + 7).alias("end"), h["attributes"].alias("attributes"))))
    return S.header_extraction(papers_view(spark, sf).withColumn("sectionheader", twice), with_text=False).select("corpusid", "start", "end_header")


@query(with_(HEADERS_SQL, "SELECT DISTINCT txt_header, section_number, extracted FROM sec"))
def list_marker_strip(spark, sf):
    return S.header_extraction(papers_view(spark, sf), with_text=False).select("txt_header", "section_number", "extracted").distinct()


def _by_header(spark, sf, label: Column) -> DataFrame:
    return S.header_extraction(papers_view(spark, sf), with_text=False).select("extracted").distinct().withColumn("label", label)


@query(with_(LABELS_SQL, "SELECT DISTINCT extracted, exact_label AS label FROM lab"))
def exact_label(spark, sf):
    return _by_header(spark, sf, S.exact_label(F.col("extracted")))


@query(with_(LABELS_SQL, "SELECT DISTINCT extracted, pattern_label AS label FROM lab"))
def regex_label(spark, sf):
    return _by_header(spark, sf, S.pattern_label(F.col("extracted")))


@query(with_(LABELS_SQL, "SELECT DISTINCT extracted, section_alt_label AS label FROM lab"))
def alt_label(spark, sf):
    return _by_header(spark, sf, S.alternative_label(F.col("extracted")))


@query(with_(LABELS_SQL, "SELECT corpusid, start, section_alt_label, sec_map FROM mapped"))
def label_coalesce(spark, sf):
    return mapped(spark, sf).select("corpusid", "start", "section_alt_label", "sec_map")


# --- sequence rules -----------------------------------------------------------------------------


@query(with_(CLASSIFIED_SQL, "SELECT DISTINCT corpusid, last_core_start FROM ended"))
def last_core_boundary(spark, sf):
    return mapped(spark, sf).select("corpusid", S.last_core_start().cast("bigint").alias("last_core_start")).distinct()


@query(with_(CLASSIFIED_SQL, "SELECT corpusid, start, sec_map, sec_label FROM ended"))
def end_matter(spark, sf):
    return S.end_matter(mapped(spark, sf)).select("corpusid", "start", "sec_map", "sec_label")


@query(with_(CLASSIFIED_SQL, "SELECT corpusid, start, section_n, section_number, top_header FROM topped"))
def top_header_flag(spark, sf):
    return mapped(spark, sf).select("corpusid", "start", "section_n", "section_number", S.top_header().alias("top_header"))


@query(with_(CLASSIFIED_SQL, "SELECT corpusid, start, previous_label FROM topped"))
def prev_label_lag(spark, sf):
    return S.end_matter(mapped(spark, sf)).select("corpusid", "start", F.lag("sec_label").over(S.in_order()).alias("previous_label"))


@query(with_(CLASSIFIED_SQL, "SELECT corpusid, start, sec_label_new FROM dev"))
def development_label(spark, sf):
    return S.development(S.end_matter(mapped(spark, sf))).select("corpusid", "start", "sec_label_new")


@query(with_(CLASSIFIED_SQL, "SELECT corpusid, start, sec_label_extended FROM classified"))
def forward_fill(spark, sf):
    return classified(spark, sf, with_text=False).select("corpusid", "start", "sec_label_extended")


@query(with_(HEADERS_SQL, "SELECT corpusid, start, CAST(length(section_text) AS BIGINT) AS n, md5(section_text) AS digest FROM sec"))
def section_text_slice(spark, sf):
    return S.header_extraction(papers_view(spark, sf)).select("corpusid", "start", F.length("section_text").cast("bigint").alias("n"), F.md5("section_text").alias("digest"))


_CLASSIFIED = ["corpusid", "start", "end_header", "section_n", "end_section", "paper_len", "txt_header", "section_number", "extracted", "section_alt_label", "sec_map", "sec_label", "top_header", "sec_label_new", "sec_label_extended"]


@query(with_(CLASSIFIED_SQL, f"SELECT {', '.join(_CLASSIFIED)}, md5(section_text) AS digest FROM classified"))
def classified_sections(spark, sf):
    return classified(spark, sf).select(*_CLASSIFIED, F.md5("section_text").alias("digest"))


# --- aggregation and quality ---------------------------------------------------------------------


@query(with_(AGGREGATED_SQL, "SELECT corpusid, sec_label_extended, md5(section_text) AS digest, start, paper_len FROM aggregated"))
def aggregated_text(spark, sf):
    return G.text_by_label(classified(spark, sf)).select("corpusid", "sec_label_extended", F.md5("section_text").alias("digest"), "start", "paper_len")


_SHARE = "corpusid, sec_label_extended, start, paper_len, section_length, adjusted_paper_len, round(perc_of_new_total, 6) AS perc_of_new_total"


def _shares_out(df: DataFrame) -> DataFrame:
    return df.select("corpusid", "sec_label_extended", "start", "paper_len", "section_length", "adjusted_paper_len", *r6("perc_of_new_total"))


@query(with_(AGGREGATED_SQL, f"SELECT {_SHARE} FROM shares"))
def section_proportions(spark, sf):
    return _shares_out(shares(spark, sf))


@query(with_(AGGREGATED_SQL, f"SELECT {_SHARE} FROM relevant WHERE n_sections >= 2 AND max_perc <= 80"))
def quality_filter_fixed(spark, sf):
    return _shares_out(G.quality_filter(shares(spark, sf)))


_RANKED = """per AS (SELECT corpusid, max(perc_of_new_total) AS top FROM relevant GROUP BY 1),
ranked AS (SELECT top, row_number() OVER (ORDER BY top) - 1 AS r, count(*) OVER () AS n FROM per WHERE top IS NOT NULL)"""


@query(with_(f"{AGGREGATED_SQL},\n{_RANKED},\nq AS (SELECT max(top) FILTER (r = floor(0.25 * (n - 1) + 0.5)) AS q1, max(top) FILTER (r = floor(0.75 * (n - 1) + 0.5)) AS q3 FROM ranked)", f"SELECT {_SHARE} FROM relevant, q WHERE n_sections >= 2 AND max_perc <= least(100, q3 + 0.25 * (q3 - q1))"))
def quality_filter_iqr(spark, sf):
    return _shares_out(G.quality_filter(shares(spark, sf), cutoff_strategy="iqr"))


@query(with_(f"{AGGREGATED_SQL},\n{_RANKED},\nq AS (SELECT max(top) FILTER (r = floor(0.75 * (n - 1) + 0.5)) AS q3 FROM ranked)", f"SELECT {_SHARE} FROM relevant, q WHERE n_sections >= 2 AND max_perc <= q3"))
def quality_filter_percentile(spark, sf):
    return _shares_out(G.quality_filter(shares(spark, sf), cutoff_strategy="percentile"))


# --- samples and requests ----------------------------------------------------------------------

_HASH = "CAST('0x' || substr(md5('33:' || corpusid), 1, 8) AS BIGINT)"


@query(with_(PAPERS_SQL, f"SELECT corpusid, i, start FROM heads WHERE {_HASH} % 10 = 0"))
def hash_sample_auto(spark, sf):
    return P.hash_sample(heads(spark, sf), modulus=10)


@query(with_(PAPERS_SQL, f"SELECT corpusid, i, start FROM heads WHERE {_HASH} % 100 = 0"))
def hash_sample_manual(spark, sf):
    return P.hash_sample(heads(spark, sf), modulus=100)


@query(with_(PAPERS_SQL, f"SELECT count(*) FILTER ({_HASH} % 100 = 0) AS manual, count(*) FILTER ({_HASH} % 100 = 0 AND {_HASH} % 10 <> 0) AS outside FROM papers"))
def sample_subset_check(spark, sf):
    p = papers_view(spark, sf).select("corpusid")
    outside = P.hash_sample(p, modulus=100).join(P.hash_sample(p, modulus=10), "corpusid", "left_anti")
    return P.hash_sample(p, modulus=100).agg(F.count(F.lit(1)).alias("manual")).join(F.broadcast(outside.agg(F.count(F.lit(1)).alias("outside"))))


def _holey(spark, sf) -> DataFrame:
    c = classified(spark, sf)
    text = F.when(F.col("start") % 7 == 0, F.lit(None)).when(F.col("start") % 7 == 1, F.lit(" \t\n")).otherwise(F.col("section_text"))
    return c.withColumn("section_text", text).select("corpusid", "start", "sec_label_extended", "section_text")


_HOLEY = f"{CLASSIFIED_SQL},\nholey AS (SELECT corpusid, start, sec_label_extended, CASE WHEN start % 7 = 0 THEN NULL WHEN start % 7 = 1 THEN '' ELSE section_text END AS section_text FROM classified)"
_OUT_ = _labels(V.NOT_ANNOTATED)


@query(with_(_HOLEY, f"SELECT corpusid, start FROM holey WHERE trim(section_text) <> '' AND sec_label_extended NOT IN {_OUT_}"))
def annotatable_sqlnull(spark, sf):
    return P.annotatable_sqlnull(_holey(spark, sf)).select("corpusid", "start")


@query(with_(_HOLEY, f"SELECT corpusid, start FROM holey WHERE coalesce(section_text <> '', true) AND NOT coalesce(sec_label_extended IN {_OUT_}, false)"))
def annotatable_pandas(spark, sf):
    return P.annotatable_pandas(_holey(spark, sf)).select("corpusid", "start")


@query(with_(_HOLEY, f"SELECT corpusid, start FROM holey WHERE coalesce(section_text, '') <> '' AND NOT coalesce(sec_label_extended IN {_OUT_}, false)"))
def annotatable_fillna(spark, sf):
    return P.annotatable_fillna(_holey(spark, sf)).select("corpusid", "start")


_KEPT = f"{CLASSIFIED_SQL},\nkept AS (SELECT *, row_number() OVER (PARTITION BY corpusid ORDER BY start) - 1 AS section_idx FROM classified WHERE NOT coalesce(sec_label_extended IN {_OUT_}, false))"


@query(with_(_KEPT, "SELECT corpusid, start, section_idx, corpusid || '-' || section_idx AS custom_id FROM kept"))
def section_ordinal(spark, sf):
    k = P.section_ordinal(P.annotatable_pandas(classified(spark, sf)))
    return k.select("corpusid", "start", "section_idx", P.ids_of(k).alias("custom_id"))


@query(with_(_KEPT, "SELECT corpusid, start, coalesce(string_agg(extracted, '|') OVER (PARTITION BY corpusid ORDER BY start ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS previous_headers, coalesce(string_agg(extracted, '|') OVER (PARTITION BY corpusid ORDER BY start ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '') AS next_headers FROM kept"))
def context_headers(spark, sf):
    k = P.context_headers(P.annotatable_pandas(classified(spark, sf)))
    return k.select("corpusid", "start", F.concat_ws("|", "previous_headers").alias("previous_headers"), F.concat_ws("|", "next_headers").alias("next_headers"))


def _requests(spark, sf) -> DataFrame:
    k = B.prompt(P.context_headers(P.section_ordinal(P.annotatable_pandas(classified(spark, sf)))))
    return k.withColumn("custom_id", P.ids_of(k)).withColumn("n_tokens", B.tokens(F.col("prompt")))


_REQUESTS = f"""{_KEPT},
ctx AS (SELECT *, coalesce(string_agg(extracted, ' | ') OVER (PARTITION BY corpusid ORDER BY start ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS a,
  coalesce(string_agg(extracted, ' | ') OVER (PARTITION BY corpusid ORDER BY start ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '') AS b,
  array_to_string(list_slice(list_filter(string_split_regex(section_text, '\\s+'), lambda x: x <> ''), 1, 300), ' ') AS snip FROM kept),
prompts AS (SELECT corpusid, section_idx, corpusid || '-' || section_idx AS custom_id,
  'Headers before: ' || a || chr(10) || 'Header: ' || coalesce(extracted, '') || chr(10) || 'Headers after: ' || b || chr(10) || 'Text: ' || snip AS prompt FROM ctx)"""


@query(with_(_REQUESTS, "SELECT custom_id, md5(prompt) AS prompt_digest, 'POST' AS method, 'input_text' AS kind FROM prompts"))
def batch_request_json(spark, sf):
    """Requests are written as JSON and read back: ids and prompts survive the round trip."""
    line = B.request(F.col("custom_id"), F.col("prompt"))
    body = "struct<custom_id:string,method:string,body:struct<input:array<struct<content:array<struct<type:string,text:string>>>>>>"
    r = _requests(spark, sf).select(F.from_json(line, body).alias("r"))
    content = F.col("r.body.input")[0]["content"][0]
    return r.select("r.custom_id", F.md5(content["text"]).alias("prompt_digest"), "r.method", content["type"].alias("kind"))


_PACKED = f"""{_REQUESTS},
req AS (SELECT corpusid, section_idx, custom_id, len(list_filter(string_split_regex(prompt, '\\s+'), lambda x: x <> '')) AS n FROM prompts),
per AS (SELECT corpusid, coalesce(sum(sum(n)) OVER (ORDER BY corpusid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM req GROUP BY corpusid),
o AS (SELECT r.*, floor(before / 80000) AS pack, row_number() OVER (PARTITION BY floor(before / 80000) ORDER BY corpusid, section_idx) AS k FROM req r JOIN per USING (corpusid)),
pk AS (SELECT pack, k, custom_id, n, 1 AS batch, n AS used FROM o WHERE k = 1
  UNION ALL SELECT o.pack, o.k, o.custom_id, o.n, CASE WHEN used > 0 AND used + o.n > 20000 THEN batch + 1 ELSE batch END, CASE WHEN used > 0 AND used + o.n > 20000 THEN o.n ELSE used + o.n END FROM pk JOIN o ON o.pack = pk.pack AND o.k = pk.k + 1),
files AS (SELECT pack, coalesce(sum(max(batch)) OVER (ORDER BY pack ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM pk GROUP BY pack)"""


@query("WITH RECURSIVE " + _PACKED + "\nSELECT custom_id, CAST(n AS BIGINT) AS n_tokens, CAST(batch + ahead AS BIGINT) AS batch FROM pk JOIN files USING (pack)")
def batch_packing(spark, sf):
    """Files of at most 20,000 tokens, ranges of four files."""
    r = _requests(spark, sf).select("corpusid", "section_idx", "custom_id", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    return B.pack(r, limit=20_000, files=4).select("custom_id", "n_tokens", "batch")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_decode(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '\\n', chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x <> '0') AS l FROM documents)
SELECT doc_id, len(list_filter(l, lambda x, i: list_position(l, x) = i)) AS n, md5(coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10)), '')) AS digest FROM p""")
def header_lines_distinct(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.lines(F.col("text")).alias("l"))
    return d.select("doc_id", F.size("l").cast("bigint").alias("n"), F.md5(F.array_join("l", "\n")).alias("digest"))


# --- raters ------------------------------------------------------------------------------------


@query(with_(VOTES_SQL, "SELECT paper_id, section_idx, label, count(*) AS votes, round(count(*) / sum(count(*)) OVER (PARTITION BY paper_id, section_idx), 6) AS share FROM valid GROUP BY paper_id, section_idx, label"))
def vote_counts(spark, sf):
    return E.vote_counts(valid_votes(spark, sf)).select("paper_id", "section_idx", "label", "votes", *r6("share"))


@query(with_(VOTES_SQL, "SELECT paper_id, section_idx, count(*) AS n_votes, min(label) AS consensus FROM valid GROUP BY 1, 2 HAVING count(DISTINCT label) = 1"))
def consensus_unanimous(spark, sf):
    return E.unanimous(valid_votes(spark, sf)).select("paper_id", "section_idx", "n_votes", "consensus")


@query(with_(f"{VOTES_SQL},\n{_MAJORITY_SQL}", "SELECT paper_id, section_idx, consensus FROM majority"))
def consensus_majority(spark, sf):
    return E.majority(valid_votes(spark, sf)).select("paper_id", "section_idx", "consensus")


@query(with_(f"{PAPERS_SQL},\n{LLM_SQL},\n{_TOP_SQL}", "SELECT paper_id, section_idx, label, n AS votes FROM top WHERE rn = 1"))
def llm_mode(spark, sf):
    return E.top_label(llm_runs(spark, sf)).select("paper_id", "section_idx", "label", "votes")


@query(with_(VOTES_SQL, "SELECT paper_id, section_idx, arg_max(label, annotator_id) AS label, max(annotator_id) AS annotator_id FROM votes GROUP BY 1, 2"))
def latest_duplicate(spark, sf):
    return E.latest(votes(spark, sf), E.ITEM, F.col("annotator_id")).select("paper_id", "section_idx", "label", "annotator_id")


@query(with_(WIDE_SQL, "SELECT * FROM wide"))
def rater_merge(spark, sf):
    return wide(spark, sf).select("paper_id", "section_idx", "start", "classification_label", "llm_label", "manual_label")


@query(with_(WIDE_SQL, "SELECT paper_id, section_idx FROM wide WHERE (classification_label IS NOT NULL)::INT + (llm_label IS NOT NULL)::INT + (manual_label IS NOT NULL)::INT > 1"))
def two_raters_at_least(spark, sf):
    return E.at_least_two(wide(spark, sf), "classification_label", "llm_label", "manual_label").select("paper_id", "section_idx")


@query(with_(WIDE_SQL, f"SELECT paper_id, section_idx FROM wide WHERE NOT coalesce(llm_label IN {_labels(V.UNSUPPORTED)}, false) AND NOT coalesce(manual_label IN {_labels(V.UNSUPPORTED)}, false)"))
def unsupported_filter(spark, sf):
    return E.without_labels(wide(spark, sf), "llm_label", "manual_label").select("paper_id", "section_idx")


@query(with_(PAIRS_SQL, "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM prf"))
def per_label_prf(spark, sf):
    return E.scores(E.label_counts(metric_pairs(spark, sf), "true_label", "pred_label")).select("label", *r6("precision", "recall", "f1"), "support")


@query(with_(PAIRS_SQL, "SELECT round(sum(f1) / 7, 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM prf"))
def macro_weighted_f1(spark, sf):
    return E.averages(E.label_counts(metric_pairs(spark, sf), "true_label", "pred_label"), V.RELEVANT).select(*r6("macro_f1", "weighted_f1"))


@query(with_(PAIRS_SQL, """SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM prf
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM prf
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM prf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM prf"""))
def classification_report(spark, sf):
    return E.report(metric_pairs(spark, sf), "true_label", "pred_label").select("label", *r6("precision", "recall", "f1"), "support")


@query(with_(PAIRS_SQL, "SELECT l.label, " + ", ".join(f"CAST(count(*) FILTER (p.pred_label = '{x}') AS BIGINT) AS {x}" for x in V.RELEVANT) + f" FROM (SELECT unnest([{', '.join(repr(x) for x in V.RELEVANT)}]) AS label) l LEFT JOIN pairs p ON p.true_label = l.label GROUP BY 1"))
def confusion_matrix(spark, sf):
    return E.confusion(metric_pairs(spark, sf), "true_label", "pred_label", V.RELEVANT)


@query(with_(PAIRS_SQL, "SELECT label, round(f1, 6) AS f1 FROM prf"))
def symmetric_f1(spark, sf):
    """F1 is the same with the raters swapped, so one pass gives the mean of both directions."""
    swapped = metric_pairs(spark, sf).select(F.col("pred_label").alias("a"), F.col("true_label").alias("b"))
    return E.scores(E.label_counts(swapped, "a", "b")).select("label", *r6("f1"))


def _f1_sql(name: str, a: str, b: str) -> str:
    return f"""{name}_roles AS (SELECT {a} AS label, ({a} = {b})::BIGINT AS tp, ({a} <> {b})::BIGINT AS miss FROM wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL
  UNION ALL SELECT {b}, 0, ({a} <> {b})::BIGINT FROM wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
{name} AS (SELECT label, 2 * sum(tp) / nullif(2 * sum(tp) + sum(miss), 0) AS f1 FROM {name}_roles GROUP BY 1)"""


_RATER_PAIRS = {"classifier_human": ("classification_label", "manual_label"), "llm_human": ("llm_label", "manual_label"), "classifier_llm": ("classification_label", "llm_label")}


@query(with_(",\n".join([WIDE_SQL, *(_f1_sql(n, a, b) for n, (a, b) in _RATER_PAIRS.items())]), "SELECT label, " + ", ".join(f"round(coalesce({n}.f1, 0), 6) AS {n}" for n in _RATER_PAIRS) + " FROM classifier_human FULL JOIN llm_human USING (label) FULL JOIN classifier_llm USING (label)"))
def aligned_f1(spark, sf):
    return E.aligned_f1(stored(wide(spark, sf)), _RATER_PAIRS).select("label", *r6(*_RATER_PAIRS))


@query(with_(VOTES_SQL, "SELECT paper_id, section_idx, annotator_id, label FROM votes WHERE annotator_id >= 69 AND label IS NOT NULL AND paper_id NOT IN (3, 8)"))
def qualified_votes(spark, sf):
    return E.qualified(votes(spark, sf), excluded=(3, 8)).select("paper_id", "section_idx", "annotator_id", "label")


def _item() -> Column:
    return F.concat_ws("-", F.col("paper_id"), F.col("section_idx"))


def _ratings(spark, sf) -> DataFrame:
    return E.long_form(stored(wide(spark, sf)), _item(), {"classifier": "classification_label", "llm": "llm_label", "human": "manual_label"})


_LONG_SQL = f"""{WIDE_SQL},
long AS (SELECT paper_id || '-' || section_idx AS item, unnest(['classifier', 'llm', 'human']) AS annotator, unnest([classification_label, llm_label, manual_label]) AS label FROM wide),
rated AS (SELECT * FROM long WHERE label IS NOT NULL)"""


def _alpha_sql(where: str = "true") -> str:
    return f"""{_LONG_SQL},
both_ AS (SELECT item FROM rated WHERE annotator IN ('llm', 'human') GROUP BY 1 HAVING count(DISTINCT annotator) = 2),
r AS (SELECT * FROM rated SEMI JOIN both_ USING (item) WHERE annotator IN ('llm', 'human') AND {where}),
cells AS (SELECT item, label, count(*) AS n FROM r GROUP BY 1, 2),
units AS (SELECT item, sum(n) AS m, sum(n * n) AS s FROM cells GROUP BY 1 HAVING sum(n) > 1),
o AS (SELECT sum((m * m - s) / (m - 1)) / sum(m) AS d_o, sum(m) AS n FROM units),
e AS (SELECT sum(n * n) AS squares FROM (SELECT label, sum(n) AS n FROM cells SEMI JOIN units USING (item) GROUP BY 1)),
k AS (SELECT count(DISTINCT annotator) AS raters, count(DISTINCT item) AS units FROM r)"""


_ALPHA = "SELECT raters, units, round(CASE WHEN raters >= 2 AND units >= 2 THEN 1 - d_o / nullif((n * n - squares) / (n * (n - 1)), 0) END, 6) AS alpha FROM o, e, k"


@query(with_(_alpha_sql(f"label NOT IN {_labels(V.UNSUPPORTED)}"), _ALPHA))
def krippendorff_alpha(spark, sf):
    """Unsupported labels are left out after the common items have been found."""
    common = E.common_items(_ratings(spark, sf), "llm", "human")
    return E.alpha(E.without_labels(common, "label")).select("raters", "units", *r6("alpha"))


@query(with_(_alpha_sql(), _ALPHA))
def krippendorff_option_b(spark, sf):
    return E.alpha(E.common_items(_ratings(spark, sf), "llm", "human")).select("raters", "units", *r6("alpha"))


@query(with_(_LONG_SQL, "SELECT item FROM rated WHERE annotator = 'llm' INTERSECT SELECT item FROM rated WHERE annotator = 'human'"))
def rater_item_intersection(spark, sf):
    r = _ratings(spark, sf)
    return r.where("annotator = 'llm'").select("item").intersect(r.where("annotator = 'human'").select("item"))


@query(with_(_LONG_SQL, "SELECT label FROM rated WHERE annotator = 'llm' UNION SELECT label FROM rated WHERE annotator = 'classifier'"))
def label_present_union(spark, sf):
    r = _ratings(spark, sf)
    return r.where("annotator = 'llm'").select("label").union(r.where("annotator = 'classifier'").select("label")).distinct()


@query(with_(f"{PAPERS_SQL},\n{LLM_SQL}", "SELECT paper_id || '-' || section_idx || '-' || run_id AS custom_id, label, ['high', 'medium', 'low'][CAST(section_idx % 3 AS INT) + 1] AS confidence FROM llm WHERE paper_id % 11 <> 0"))
def llm_response_extract(spark, sf):
    """Result lines with the answer behind a reasoning entry; failed requests give no label."""
    r = llm_runs(spark, sf).withColumn("custom_id", F.concat_ws("-", "paper_id", "section_idx", "run_id"))
    answer = F.to_json(F.struct("label", F.array(*[F.lit(x) for x in ("high", "medium", "low")])[(F.col("section_idx") % 3).cast("int")].alias("confidence")))
    thought = F.struct(F.lit("reasoning").alias("type"), F.array().cast("array<struct<text:string>>").alias("content"))
    said = F.struct(F.lit("message").alias("type"), F.array(F.struct(answer.alias("text"))).alias("content"))
    body = F.struct(F.array(thought, said).alias("output"))
    line = F.to_json(F.struct("custom_id", F.when(F.col("paper_id") % 11 == 0, "failed").alias("error"), F.struct(body.alias("body")).alias("response")))
    return r.select(B.response(line).alias("x")).select("x.*").where("label is not null")


# --- cutoffs -----------------------------------------------------------------------------------

_METRICS = f"""metrics AS (SELECT corpusid, CAST(sum(section_length) AS BIGINT) AS total_section_length, max(section_length) AS longest_section_length, count(section_length) AS n_sections,
  max(section_length)::DOUBLE / nullif(sum(section_length), 0)::DOUBLE * 100 AS longest_section_percent FROM shares WHERE sec_label_extended IN {_labels(V.RELEVANT)} GROUP BY 1)"""
_CUTS = f"""qs AS (SELECT quantile_cont(longest_section_percent, [0.25, 0.75, {', '.join(str(p / 100) for p in C.PERCENTILES)}]) AS q FROM metrics),
raw_cuts AS (SELECT 'iqr' AS strategy, k AS parameter, least(100, q[2] + k * (q[2] - q[1])) AS threshold FROM qs, (SELECT unnest([{', '.join(map(str, C.IQR_STEPS))}])::DOUBLE AS k)
  UNION ALL SELECT 'percentile', unnest([{', '.join(map(str, C.PERCENTILES))}])::DOUBLE, unnest(q[3:]) FROM qs),
cuts AS (SELECT strategy, min(parameter) AS parameter, threshold FROM (SELECT strategy, parameter, round(least(100, greatest(0, threshold)), 9) AS threshold FROM raw_cuts) GROUP BY strategy, threshold)"""
_GRID = f"""roles_ AS (SELECT c.strategy, c.parameter, c.threshold, ms.min_sections, p.corpusid, p.true_label, p.pred_label FROM pairs p JOIN metrics m USING (corpusid)
  JOIN (cuts c CROSS JOIN (SELECT unnest([2, 3]) AS min_sections) ms) ON m.n_sections >= ms.min_sections AND round(m.longest_section_percent, 9) <= c.threshold),
lab_ AS (SELECT strategy, parameter, threshold, min_sections, true_label AS label, (true_label = pred_label)::BIGINT AS tp, 0 AS fp, (true_label <> pred_label)::BIGINT AS fn FROM roles_
  UNION ALL SELECT strategy, parameter, threshold, min_sections, pred_label, 0, (true_label <> pred_label)::BIGINT, 0 FROM roles_),
per_ AS (SELECT strategy, parameter, threshold, min_sections, label, sum(tp) + sum(fn) AS support, 2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0) AS f1 FROM lab_ GROUP BY ALL),
f1_ AS (SELECT strategy, parameter, threshold, min_sections, sum(f1) / 7 AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM per_ GROUP BY ALL),
size_ AS (SELECT strategy, parameter, threshold, min_sections, count(DISTINCT corpusid) AS eval_papers, count(*) AS eval_sections FROM roles_ GROUP BY ALL),
grid AS (SELECT c.strategy, c.parameter, c.threshold, ms.min_sections, (SELECT count(*) FROM metrics m WHERE m.n_sections >= ms.min_sections AND round(m.longest_section_percent, 9) <= c.threshold) AS retained_papers,
  (SELECT count(*) FROM metrics) AS all_papers, coalesce(s.eval_papers, 0) AS eval_papers, coalesce(s.eval_sections, 0) AS eval_sections, f.macro_f1, f.weighted_f1
  FROM cuts c CROSS JOIN (SELECT unnest([2, 3]) AS min_sections) ms LEFT JOIN size_ s USING (strategy, parameter, threshold, min_sections) LEFT JOIN f1_ f USING (strategy, parameter, threshold, min_sections))"""
_AGG_REST = AGGREGATED_SQL[len(CLASSIFIED_SQL) :]
_GRID_ALL = f"{PAIRS_SQL}{_AGG_REST},\n{_METRICS},\n{_CUTS},\n{_GRID}"


@query(with_(f"{AGGREGATED_SQL},\n{_METRICS}", "SELECT corpusid, total_section_length, longest_section_length, n_sections, round(longest_section_percent, 6) AS longest_section_percent FROM metrics"))
def paper_metrics(spark, sf):
    return C.paper_metrics(lengths(spark, sf)).select("corpusid", "total_section_length", "longest_section_length", "n_sections", *r6("longest_section_percent"))


@query(with_(f"{AGGREGATED_SQL},\n{_METRICS},\n{_CUTS}", "SELECT strategy, parameter, round(threshold, 6) AS threshold FROM cuts"))
def thresholds(spark, sf):
    return C.thresholds(C.paper_metrics(lengths(spark, sf))).select("strategy", "parameter", *r6("threshold"))


def _grid(spark, sf) -> DataFrame:
    c = stored(classified(spark, sf, with_text=False).select("corpusid", "start", "paper_len", "section_chars", "sec_label_extended"))  # used twice
    m = stored(C.paper_metrics(lengths(spark, sf, c)))
    return C.threshold_grid(stored(C.thresholds(m)), m, stored(metric_pairs(spark, sf, c)))


_GRID_COLS = "strategy, parameter, round(threshold, 6) AS threshold, min_sections, retained_papers, round(retained_papers / all_papers, 6) AS retention_rate, eval_papers, eval_sections, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1"


def _grid_out(g: DataFrame) -> DataFrame:
    return g.select("strategy", "parameter", *r6("threshold"), "min_sections", "retained_papers", *r6("retention_rate"), "eval_papers", "eval_sections", *r6("macro_f1", "weighted_f1"))


@query(with_(_GRID_ALL, f"SELECT {_GRID_COLS} FROM grid"))
def threshold_grid(spark, sf):
    return _grid_out(_grid(spark, sf))


@query(with_(f"{_GRID_ALL},\nbest AS (SELECT *, row_number() OVER (PARTITION BY strategy, min_sections ORDER BY retained_papers DESC, threshold DESC) AS rn FROM (SELECT *, max(macro_f1) OVER (PARTITION BY strategy, min_sections) AS top FROM grid) WHERE round(macro_f1, 9) >= round(top - 0.01, 9))", f"SELECT {_GRID_COLS} FROM best WHERE rn = 1"))
def stable_choice(spark, sf):
    return _grid_out(C.stable_choice(_grid(spark, sf)))


@query(with_(f"{_GRID_ALL},\nnear AS (SELECT *, row_number() OVER (PARTITION BY strategy, min_sections ORDER BY round(abs(threshold - 80), 6), threshold) AS rn FROM grid)", f"SELECT {_GRID_COLS} FROM near WHERE rn = 1"))
def nearest_to_80(spark, sf):
    return _grid_out(C.nearest_to(_grid(spark, sf)))


@query(with_(_GRID_ALL, f"SELECT {_GRID_COLS} FROM (SELECT * FROM grid ORDER BY round(macro_f1, 6) DESC NULLS LAST, retained_papers DESC, strategy, min_sections, round(threshold, 6) LIMIT 10)"))
def best_by_f1(spark, sf):
    return _grid_out(C.best_by_f1(_grid(spark, sf)))


@query(with_(f"{WIDE_SQL}{_AGG_REST},\n{_METRICS}", f"""SELECT m.paper_id, h.start, m.consensus AS true_label, c.sec_label_extended AS pred_label, x.n_sections, round(x.longest_section_percent, 6) AS longest_section_percent
FROM majority m LEFT JOIN heads h ON h.corpusid = m.paper_id AND h.i = m.section_idx JOIN classified c ON c.corpusid = m.paper_id AND c.start = h.start LEFT JOIN metrics x ON x.corpusid = m.paper_id
WHERE m.consensus IN {_labels(V.RELEVANT)} AND c.sec_label_extended IN {_labels(V.RELEVANT)}"""))
def human_eval_rows(spark, sf):
    places = heads(spark, sf).select(F.col("corpusid").alias("paper_id"), F.col("i").alias("section_idx"), "start")
    c = classified(spark, sf, with_text=False)
    rows = C.human_eval_rows(E.majority(valid_votes(spark, sf)), places, c, C.paper_metrics(lengths(spark, sf)))
    return rows.select("paper_id", "start", "true_label", "pred_label", "n_sections", *r6("longest_section_percent"))


@query(with_(f"{AGGREGATED_SQL},\n{_METRICS}", "SELECT CAST(n_sections AS BIGINT) AS value, round(max(r) / max(n), 6) AS share FROM (SELECT n_sections, row_number() OVER (ORDER BY n_sections) AS r, count(*) OVER () AS n FROM metrics) GROUP BY 1"))
def ecdf(spark, sf):
    return C.ecdf(C.paper_metrics(lengths(spark, sf)), "n_sections").select("value", *r6("share"))


@query(with_(f"{AGGREGATED_SQL},\n{_METRICS}", "SELECT CAST(least(floor(longest_section_percent / (100 / 60)), 59) AS INT) AS bin, count(*) AS n FROM metrics WHERE longest_section_percent BETWEEN 0 AND 100 GROUP BY 1"))
def histogram(spark, sf):
    return C.histogram(C.paper_metrics(lengths(spark, sf)), "longest_section_percent", 0.0, 100.0)


@query(with_(f"{AGGREGATED_SQL},\n{_METRICS}", "SELECT k, round(avg((n_sections >= k)::INT), 6) AS share FROM metrics, (SELECT unnest(range(1, (SELECT max(n_sections) FROM metrics) + 1)) AS k) GROUP BY 1"))
def retained_by_min_sections(spark, sf):
    return C.retained_by_count(C.paper_metrics(lengths(spark, sf))).select("k", *r6("share"))


@query(with_(f"{AGGREGATED_SQL},\n{_METRICS},\nq AS (SELECT quantile_cont(longest_section_percent, [0.5, 0.75, 0.9, 0.95, 0.99]) AS q, avg((n_sections >= 2)::INT) AS a, avg((n_sections >= 3)::INT) AS b FROM metrics)", "SELECT " + ", ".join(f"round(q[{i + 1}], 6) AS {x}" for i, x in enumerate(("median", "p75", "p90", "p95", "p99"))) + ", round(a, 6) AS share_2, round(b, 6) AS share_3 FROM q"))
def summary_quantiles(spark, sf):
    return C.summary(C.paper_metrics(lengths(spark, sf))).select(*r6("median", "p75", "p90", "p95", "p99", "share_2", "share_3"))


# --- annotation store --------------------------------------------------------------------------


def annotators(spark, sf) -> DataFrame:
    """Customers as annotators."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    edu = F.array(*[F.lit(x) for x in ("bachelors", "masters", "phd_in_progress", "phd_completed", "postdoc")])[(F.col("c_custkey") % 5).cast("int")]
    lang = F.when(F.col("c_custkey") % 3 == 0, "other").when(F.col("c_custkey") % 17 == 0, F.lit(None)).otherwise("english")
    return c.select(F.col("c_custkey").alias("annotator_id"), F.col("c_name").alias("prolific_id"), edu.alias("education_level"), lang.alias("first_language"), F.col("c_custkey").alias("created_at"))


_ANNOTATORS = "annotators AS (SELECT c_custkey AS annotator_id, c_name AS prolific_id, ['bachelors', 'masters', 'phd_in_progress', 'phd_completed', 'postdoc'][CAST(c_custkey % 5 AS INT) + 1] AS education_level, CASE WHEN c_custkey % 3 = 0 THEN 'other' WHEN c_custkey % 17 = 0 THEN NULL ELSE 'english' END AS first_language, c_custkey AS created_at FROM customer)"


def assigned(spark, sf) -> DataFrame:
    """Orders as assignments of papers (o_orderkey % 97) to annotators."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    g = o.groupBy(F.col("o_custkey").alias("annotator_id"), (F.col("o_orderkey") % 997).alias("paper_id"))
    return g.agg(F.min("o_orderkey").alias("assigned_at"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("done")).select("annotator_id", "paper_id", "assigned_at", (F.col("done") == 1).alias("completed"))


_ASSIGNED = "assigned AS (SELECT o_custkey AS annotator_id, o_orderkey % 997 AS paper_id, min(o_orderkey) AS assigned_at, max((o_orderstatus = 'F')::INT) = 1 AS completed FROM orders GROUP BY 1, 2)"


@query(with_(f"{VOTES_SQL},\n{_ANNOTATORS}", "SELECT a.prolific_id, v.paper_id, v.section_idx AS section_order, v.start, v.label, CASE WHEN v.is_other_language THEN 'True' ELSE 'False' END AS is_other_language, CASE WHEN v.is_annotator_confused THEN 'True' ELSE 'False' END AS is_annotator_confused, v.paper_id + v.section_idx AS created_at FROM votes v JOIN annotators a USING (annotator_id) WHERE v.annotator_id = 70"))
def annotation_export(spark, sf):
    v = votes(spark, sf).withColumn("section_id", _item()).withColumn("created_at", F.col("paper_id") + F.col("section_idx"))
    sections = heads(spark, sf).select(F.concat_ws("-", "corpusid", "i").alias("id"), F.col("i").alias("section_order"), F.col("start").alias("start_position"))
    return A.export(v, annotators(spark, sf), sections, annotator_id=70)


@query(with_(_ASSIGNED + ",\nn AS (SELECT p.paper_id, count(DISTINCT a.annotator_id) % 4 AS k FROM (SELECT unnest(range(0, 997)) AS paper_id) p LEFT JOIN assigned a ON a.paper_id = p.paper_id AND a.completed GROUP BY 1)", "SELECT CAST(coalesce(sum((k = 0)::INT), 0) AS BIGINT) AS papers_none, CAST(sum((k = 1)::INT) AS BIGINT) AS papers_one, CAST(sum((k = 2)::INT) AS BIGINT) AS papers_two, CAST(sum((k >= 3)::INT) AS BIGINT) AS papers_three_or_more, count(*) AS papers FROM n"))
def annotation_summary(spark, sf):
    n = assigned(spark, sf).where("completed").groupBy("paper_id").agg((F.countDistinct("annotator_id") % 4).alias("k"))
    papers = spark.range(997).select(F.col("id").alias("paper_id")).join(n, "paper_id", "left")
    return A.coverage(papers.select(F.coalesce("k", F.lit(0)).alias("n_annotations")))


@query(with_(f"{_ANNOTATORS},\n{_ASSIGNED}", "SELECT a.annotator_id, a.prolific_id, a.created_at, count(DISTINCT s.paper_id) AS completed_papers FROM annotators a LEFT JOIN assigned s ON s.annotator_id = a.annotator_id AND s.completed GROUP BY 1, 2, 3 ORDER BY a.created_at DESC, a.annotator_id LIMIT 20"))
def admin_recent(spark, sf):
    return A.recent(annotators(spark, sf), assigned(spark, sf)).select("annotator_id", "prolific_id", "created_at", "completed_papers")


@query(with_(f"{VOTES_SQL},\n{_ANNOTATORS},\n{_ASSIGNED}", "SELECT (SELECT count(*) FROM annotators) AS annotators, (SELECT count(*) FROM assigned WHERE completed) AS completed_papers, (SELECT count(DISTINCT annotator_id || '-' || paper_id) FROM assigned) AS pairs, (SELECT count(label) FROM votes) AS labels"))
def admin_totals(spark, sf):
    return A.totals(annotators(spark, sf), assigned(spark, sf), votes(spark, sf))


def submitted(spark, sf) -> DataFrame:
    """Urgent orders as annotations handed in."""
    o = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderpriority like '1%'")
    return o.select(F.col("o_custkey").alias("annotator_id"), (F.col("o_orderkey") % 997).alias("paper_id"))


_SUBMITTED = "submitted AS (SELECT o_custkey AS annotator_id, o_orderkey % 997 AS paper_id FROM orders WHERE o_orderpriority LIKE '1%')"


@query(with_(f"{_ASSIGNED},\n{_SUBMITTED}", "SELECT p.paper_id, (SELECT count(DISTINCT annotator_id) FROM submitted a WHERE a.paper_id = p.paper_id) AS n_annotators FROM (SELECT unnest(range(0, 997)) AS paper_id) p WHERE (SELECT count(DISTINCT annotator_id) FROM submitted a WHERE a.paper_id = p.paper_id) < 3 AND p.paper_id NOT IN (SELECT paper_id FROM assigned WHERE annotator_id = 7)"))
def assignable_papers(spark, sf):
    return A.assignable(spark.range(997).select(F.col("id").alias("paper_id")), assigned(spark, sf), submitted(spark, sf), 7).select("paper_id", "n_annotators")


@query(with_(_ASSIGNED + f",\nopen_ AS (SELECT paper_id, n_annotators, {_HASH.replace('corpusid', 'paper_id')} AS h FROM (SELECT paper_id, count(DISTINCT annotator_id) AS n_annotators FROM assigned GROUP BY 1))", "SELECT paper_id FROM open_ ORDER BY h, paper_id LIMIT 10"))
def random_assignment(spark, sf):
    return P.random_choice(assigned(spark, sf).select("paper_id").distinct(), 10, 33, "paper_id")


@query(with_(_ASSIGNED, "SELECT annotator_id, arg_min(paper_id, (assigned_at, paper_id)) AS paper_id FROM assigned WHERE NOT completed GROUP BY 1"))
def first_open_paper(spark, sf):
    return A.first_open(assigned(spark, sf))


@query(with_(f"{VOTES_SQL},\nkey AS (SELECT DISTINCT paper_id, section_idx, {_PICK}[CAST((paper_id * 7 + section_idx * 3) % 10 AS INT) + 1] AS label FROM votes WHERE paper_id % 10 = 3),\nn AS (SELECT v.annotator_id, count(DISTINCT k.paper_id || '-' || k.section_idx) AS correct FROM votes v LEFT JOIN key k ON k.paper_id = v.paper_id AND k.section_idx = v.section_idx AND k.label = v.label GROUP BY 1)", "SELECT annotator_id, round(correct / (SELECT count(*) FROM key), 6) AS accuracy, correct / (SELECT count(*) FROM key) >= 0.7 AS passed FROM n"))
def attention_accuracy(spark, sf):
    v = votes(spark, sf).withColumn("section_id", _item())
    key = v.where("paper_id % 10 = 3").select("section_id", pick(F.col("paper_id") * 7 + F.col("section_idx") * 3).alias("correct_label")).distinct()
    return A.attention(v.select("annotator_id", "section_id", "label"), key).select("annotator_id", *r6("accuracy"), "passed")


@query(with_(_ANNOTATORS, """SELECT annotator_id, coalesce(education_level IN ('masters', 'phd_completed', 'phd_in_progress', 'postdoc') AND first_language = 'english', false) AS passed,
CASE WHEN NOT coalesce(education_level IN ('masters', 'phd_completed', 'phd_in_progress', 'postdoc') AND first_language = 'english', false) THEN 'screened_out' WHEN annotator_id % 4 = 1 THEN 'annotate' WHEN annotator_id % 3 >= 2 THEN 'screened_out' ELSE 'attention_check' END AS next_step FROM annotators"""))
def screening(spark, sf):
    ok = A.passes_screening(F.col("education_level"), F.col("first_language"))
    step = A.next_step(ok, F.col("annotator_id") % 4 == 1, F.col("annotator_id") % 3)
    return annotators(spark, sf).select("annotator_id", ok.alias("passed"), step.alias("next_step"))


@query("""SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL
SELECT id, name FROM (SELECT c_nationkey + (SELECT max(s_suppkey) FROM supplier) - 4 AS id, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS rn FROM customer) WHERE rn = 1 AND id NOT IN (SELECT s_suppkey FROM supplier)""")
def insert_ignore(spark, sf):
    old = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    top = old.agg(F.max("id").alias("top"))
    new = spark.read.parquet(f"{sf}/customer.parquet").join(F.broadcast(top)).select((F.col("c_nationkey") + F.col("top") - 4).alias("id"), F.col("c_name").alias("name"))
    return A.insert_ignore(old, new, "id", "name")


def _submissions(spark, sf) -> DataFrame:
    v = votes(spark, sf)
    again = v.where("section_idx % 2 = 0").withColumn("label", F.when(F.col("section_idx") % 4 == 0, " ").otherwise(pick(F.col("section_idx")))).withColumn("created_at", F.lit(2))
    return v.withColumn("created_at", F.lit(1)).unionByName(again)


@query(with_(f"{VOTES_SQL},\nsub AS (SELECT paper_id, section_idx, annotator_id, label, 1 AS created_at FROM votes UNION ALL SELECT paper_id, section_idx, annotator_id, CASE WHEN section_idx % 4 = 0 THEN ' ' ELSE {_PICK}[CAST(section_idx % 10 AS INT) + 1] END, 2 FROM votes WHERE section_idx % 2 = 0)", "SELECT paper_id, section_idx, annotator_id, label FROM sub s WHERE created_at = (SELECT max(created_at) FROM sub t WHERE t.annotator_id = s.annotator_id AND t.paper_id = s.paper_id) AND trim(label) <> ''"))
def replace_annotations(spark, sf):
    return A.current(_submissions(spark, sf)).select("paper_id", "section_idx", "annotator_id", "label")


@query(with_(VOTES_SQL, "SELECT annotator_id, paper_id, count(CASE WHEN section_idx % 6 <> 5 THEN label END) AS labelled, count(*) AS sections, count(CASE WHEN section_idx % 6 <> 5 THEN label END) = count(*) OR bool_or(is_other_language) AS complete FROM votes GROUP BY 1, 2"))
def completeness(spark, sf):
    v = votes(spark, sf).withColumn("label", F.when(F.col("section_idx") % 6 != 5, F.col("label")))
    return A.complete(v).select("annotator_id", "paper_id", "labelled", "sections", "complete")


@query("SELECT o_custkey AS annotator_id, o_orderkey % 997 AS paper_id, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def uniqueness_violations(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("annotator_id"), (F.col("o_orderkey") % 997).alias("paper_id"))
    return A.duplicates(o, "annotator_id", "paper_id")


@query(with_(PAPERS_SQL, "SELECT corpusid AS paper_id, start, row_number() OVER (PARTITION BY corpusid ORDER BY start DESC) - 1 AS section_order FROM heads WHERE trim(line) <> '' AND trim(header) <> ''"))
def import_ordinals(spark, sf):
    p = papers_view(spark, sf).select(F.col("corpusid").alias("paper_id"), "text", F.explode("sectionheader").alias("h"))
    body = F.split(F.substring("text", (F.col("h.start") + 1).cast("int"), F.length("text")), "\n")
    rows = p.select("paper_id", F.col("h.start").alias("start"), body[0].alias("extracted"), body[1].alias("section_text"), (-F.col("h.start")).alias("line"))
    return A.import_order(rows).select("paper_id", "start", F.col("section_order").cast("bigint").alias("section_order"))


# --- demographics ------------------------------------------------------------------------------


def _people(spark, sf) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    age = F.when(F.col("c_custkey") % 10 == 0, "DATA_EXPIRED").when(F.col("c_custkey") % 11 == 0, "").otherwise((18 + F.col("c_custkey") % 60).cast("string"))
    return c.select(age.alias("age"), F.col("c_acctbal").cast("string").alias("balance"), "c_mktsegment", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("nation"))


_PEOPLE = "people AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'DATA_EXPIRED' WHEN c_custkey % 11 = 0 THEN '' ELSE (18 + c_custkey % 60)::VARCHAR END AS age, c_acctbal AS balance, c_mktsegment, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END AS nation FROM customer)"


@query(with_(_PEOPLE + ",\nv AS (SELECT 'age' AS \"column\", try_cast(age AS DOUBLE) AS x FROM people UNION ALL SELECT 'balance', balance FROM people)", 'SELECT "column", round(avg(x), 2) AS mean, round(stddev_samp(x), 2) AS std, round(min(x), 2) AS min, round(max(x), 2) AS max, count(x) AS count FROM v GROUP BY 1'))
def demographics_stats(spark, sf):
    return D.numeric_stats(_people(spark, sf), ["age", "balance"])


@query(with_(_PEOPLE + ",\nv AS (SELECT 'c_mktsegment' AS \"column\", c_mktsegment AS value FROM people UNION ALL SELECT 'nation', nation::VARCHAR FROM people)", 'SELECT "column", value, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY "column"), 2) AS percent FROM v GROUP BY 1, 2'))
def value_counts(spark, sf):
    return D.value_counts(_people(spark, sf), ["c_mktsegment", "nation", "absent"])


@query("SELECT page_id, NOT regexp_matches(url, '(?i)mobile|android|iphone|ipad|phone|tablet') AS desktop, CASE WHEN page_id % 2 = 0 THEN 'True' ELSE 'False' END AS flag FROM pages")
def user_agent_filter(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", X.desktop(F.col("url")).alias("desktop"), X.yes_no(F.col("page_id") % 2 == 0).alias("flag"))
