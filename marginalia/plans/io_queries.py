"""Queries that go through files: what is written and read again must be what it was; and the joins of results and raters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import annotations as A
from ..operators import batches as B
from ..operators import cutoffs as C
from ..operators import demographics as D
from ..operators import evaluation as E
from ..sources import files as S
from . import queries as Q
from .papers import PAPERS_SQL, papers_view
from .queries import query
from .run import run
from .section_sql import AGGREGATED_SQL, CLASSIFIED_SQL, with_


# --- papers ------------------------------------------------------------------------------------


@query(with_(PAPERS_SQL, "SELECT p.corpusid, md5(p.text) AS digest, count(h.i) AS headers, CAST(sum(h.start) AS BIGINT) AS starts FROM papers p JOIN heads h USING (corpusid) GROUP BY ALL"))
def parquet_round_trip(spark, sf):
    """Papers written in files of at most 300 rows and read again."""
    at = S.scratch(spark)
    S.write_parquet(papers_view(spark, sf), at, max_rows=300)
    p = S.read_papers(spark, at)
    starts = F.aggregate(F.col("sectionheader")["start"], F.lit(0).cast("bigint"), lambda a, x: a + x)
    return p.select("corpusid", F.md5("text").alias("digest"), F.size("sectionheader").cast("bigint").alias("headers"), starts.alias("starts"))


@query(with_(PAPERS_SQL, "SELECT corpusid, md5(text) AS digest FROM papers ORDER BY corpusid LIMIT 25"))
def trial_papers(spark, sf):
    """The first papers by id, as a trial run takes them."""
    at = S.scratch(spark)
    S.write_parquet(papers_view(spark, sf).select("corpusid", "text"), at)
    return S.read_papers(spark, at, n_rows=25).select("corpusid", F.md5("text").alias("digest"))


def _raw(spark, sf) -> DataFrame:
    """Papers as raw rows: every annotation column a string of JSON, with quoted and plain offsets, or null."""
    d = spark.read.parquet(f"{sf}/documents.parquet")

    def column(j: int, name: str) -> Column:
        attributes = S._WITH_ATTRIBUTES.get(name, ())
        inner = ', "attributes": {' + ", ".join(f'"{a}": "{a}%d"' for a in attributes) + "}" if attributes else ""
        pattern = '{"start": "%d", "end": %d' + inner + "}"
        spans = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda x: F.format_string(pattern, x + j, x * 2 + j, *[x] * len(attributes)))
        return F.when((F.col("doc_id") + j) % 5 != 0, F.concat(F.lit("["), F.array_join(spans, ", "), F.lit("]"))).alias(name)

    cols = [column(j, name) for j, name in enumerate(S.ANNOTATIONS)]
    content = F.struct(F.col("text"), F.struct(*cols).alias("annotations"))
    return d.select(F.col("doc_id").alias("corpusid"), F.struct(F.col("source").alias("doi")).alias("externalids"), content.alias("content"))


_NAMES = "[" + ", ".join(f"'{x}'" for x in S.ANNOTATIONS) + "]"
_FIRST = "[" + ", ".join(f"'{S._WITH_ATTRIBUTES[x][0]}'" if x in S._WITH_ATTRIBUTES else "NULL" for x in S.ANNOTATIONS) + "]"
_DECODED_SQL = f"""WITH n AS (SELECT unnest({_NAMES}) AS annotation, unnest({_FIRST}) AS attribute, unnest(range({len(S.ANNOTATIONS)})) AS j),
x AS (SELECT doc_id, text, source, annotation, attribute, j, CASE WHEN (doc_id + j) % 5 <> 0 THEN range(0, doc_id % 3 + 1) END AS l FROM documents, n)
SELECT doc_id AS corpusid, source AS doi, md5(text) AS digest, annotation, CAST(len(l) AS BIGINT) AS spans, CAST(list_sum(list_transform(l, lambda v: v + j)) AS BIGINT) AS starts, CAST(list_sum(list_transform(l, lambda v: 2 * v + j)) AS BIGINT) AS ends,
  CASE WHEN l IS NOT NULL AND attribute IS NOT NULL THEN array_to_string(list_transform(l, lambda v: attribute || v), ' ') END AS attributes FROM x"""


def _decoded(raw: DataFrame) -> DataFrame:
    def row(name: str) -> Column:
        c, first = F.col(name), S._WITH_ATTRIBUTES.get(name, (None,))[0]

        def total(f: str) -> Column:
            return F.when(c.isNotNull(), F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x[f])).alias(f"{f}s")

        said = F.when(c.isNotNull(), F.array_join(F.transform(c, lambda x: x["attributes"][first]), " ")) if first else F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("annotation"), F.when(c.isNotNull(), F.size(c)).cast("bigint").alias("spans"), total("start"), total("end"), said.alias("attributes"))

    d = S.decode_annotations(raw).select("corpusid", F.col("externalids.doi").alias("doi"), F.md5("text").alias("digest"), F.explode(F.array(*[row(x) for x in S.ANNOTATIONS])).alias("r"))
    return d.select("corpusid", "doi", "digest", "r.*")


@query(_DECODED_SQL)
def decode_annotations(spark, sf):
    """All 23 annotation columns decoded from JSON strings."""
    return _decoded(_raw(spark, sf))


@query(_DECODED_SQL)
def raw_parts_round_trip(spark, sf):
    """Gzip parts of JSON lines under a download's names: renamed, schema inferred from one, read under it and decoded."""
    at = S.scratch(spark)
    _raw(spark, sf).write.option("compression", "gzip").option("maxRecordsPerFile", 10_000).json(at)  # one task unpacks a part
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(hadoop.Path(at)):
        if f.getPath().getName().endswith(".gz"):
            fs.rename(f.getPath(), hadoop.Path(at, f.getPath().getName().removesuffix(".json.gz") + ".zip"))
    S.rename_parts(spark, at)
    parts = [(f.getLen(), str(f.getPath())) for f in fs.listStatus(hadoop.Path(at)) if f.getPath().getName().endswith(".gz")]
    one = max(parts)[1]  # the largest, as Spark's first part may be empty
    return _decoded(S.read_raw(spark, at, S.infer_schema(spark, one)))


@query(with_(AGGREGATED_SQL, f"""SELECT 'classified' AS output, sec_label_extended AS label, count(*) AS n, CAST(sum(length(section_text)) AS BIGINT) AS chars FROM classified GROUP BY 2
UNION ALL SELECT 'aggregated', sec_label_extended, count(*), CAST(sum(section_length) AS BIGINT) FROM shares GROUP BY 2
UNION ALL SELECT 'filtered', sec_label_extended, count(*), CAST(sum(section_length) AS BIGINT) FROM relevant WHERE n_sections >= 2 AND max_perc <= 60 GROUP BY 2"""))
def run_outputs(spark, sf):
    """The whole run from a folder of papers to its three outputs, with a cutoff of its own."""
    at = S.scratch(spark)
    S.write_parquet(papers_view(spark, sf), f"{at}/papers")
    out = run(spark, f"{at}/papers", f"{at}/out", max_section_perc=60.0, max_rows=5000)
    parts = []
    for name, df in out.items():
        n = F.length("section_text") if name == "classified" else F.col("section_length")
        parts.append(df.groupBy(F.col("sec_label_extended").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(n).cast("bigint").alias("chars")).select(F.lit(name).alias("output"), "label", "n", "chars"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- tables and lines ----------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS digest, lang FROM documents")
def csv_round_trip(spark, sf):
    """Texts with newlines and quotes through a folder of CSV files."""
    at = S.scratch(spark)
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit('"'), "text", F.lit('\n"')).alias("quoted"), "lang")
    S.write_csv(d, at)
    r = S.read_csv(spark, at, ["doc_id", "quoted", "lang"])
    return r.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(F.expr("substring(quoted, 2, length(quoted) - 3)")).alias("digest"), "lang")


@query("WITH RECURSIVE " + Q._PACKED + "\nSELECT 'batch=' || CAST(batch + ahead AS BIGINT) AS run_id, count(*) AS requests, count(*) = count(DISTINCT custom_id) AS distinct_ids, CAST(sum(n) AS BIGINT) AS tokens, sum(n) <= 20000 OR count(*) = 1 AS within FROM pk JOIN files USING (pack) GROUP BY 1")
def batch_files(spark, sf):
    """Requests packed, written as JSON lines, a folder a batch, and read again with their folders' names: none passes the limit."""
    at = S.scratch(spark)
    r = Q._requests(spark, sf).withColumn("line", B.request(F.col("custom_id"), F.col("prompt")))
    S.write_batches(B.pack(r.select("corpusid", "section_idx", "n_tokens", "line"), limit=20_000, files=4), at)
    kind = "struct<custom_id:string,body:struct<input:array<struct<content:array<struct<text:string>>>>>>"
    got = S.read_json_lines(spark, at, recursive=True).select("run_id", F.from_json("line", kind).alias("r"))
    got = got.select("run_id", "r.custom_id", B.tokens(F.col("r.body.input")[0]["content"][0]["text"]).alias("n"))
    g = got.groupBy("run_id").agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("custom_id").alias("ids"), F.sum("n").alias("tokens"))
    return g.select("run_id", "requests", (F.col("ids") == F.col("requests")).alias("distinct_ids"), "tokens", ((F.col("tokens") <= 20_000) | (F.col("requests") == 1)).alias("within"))


def _result_lines(sample: DataFrame) -> DataFrame:
    """(line, file, pos): two result files for the requests; some answers are errors, some requests have a second answer."""
    c = B.requested(sample).select("corpusid", "section_idx", "custom_id")
    rows = c.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("f")).where("f = 0 or section_idx % 3 = 0")
    said = F.to_json(F.struct(Q.pick(F.col("corpusid") + F.col("section_idx") + F.col("f")).alias("label"), F.lit("high").alias("confidence")))
    message = F.struct(F.lit("message").alias("type"), F.array(F.struct(said.alias("text"))).alias("content"))
    body = F.struct(F.struct(F.array(message).alias("output")).alias("body")).alias("response")
    error = F.when((F.col("section_idx") + F.col("f")) % 5 == 4, F.lit("overloaded")).alias("error")
    line = F.to_json(F.struct("custom_id", error, body))
    return rows.select(line.alias("line"), F.format_string("part%d.jsonl", "f").alias("file"), F.monotonically_increasing_id().alias("pos"))


@query(with_(f"""{AGGREGATED_SQL},
{Q._METRICS},
asked AS (SELECT *, row_number() OVER (PARTITION BY corpusid ORDER BY start) - 1 AS k FROM classified WHERE NOT coalesce(sec_label_extended IN {Q._labels(V.NOT_ANNOTATED)}, false) AND trim(section_text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''),
said AS (SELECT *, CASE WHEN k % 3 = 0 AND (k + 1) % 5 <> 4 THEN 1 WHEN k % 5 <> 4 THEN 0 END AS f FROM asked)""", f"""SELECT said.corpusid || '-' || k AS custom_id, said.corpusid AS paper_id, start, sec_label_extended, {Q._PICK}[CAST((said.corpusid + k + f) % 10 AS INT) + 1] AS label, 'high' AS confidence, n_sections, round(longest_section_percent, 6) AS longest_section_percent
FROM said LEFT JOIN metrics m ON m.corpusid = said.corpusid WHERE f IS NOT NULL"""))
def results_on_requests(spark, sf):
    """Result lines joined to their requests on custom_id; the last readable answer, by file, counts."""
    # used three times; of the texts, their lengths and whether they are blank
    begins = F.substring(X.strip("section_text"), 1, 1).alias("section_text")
    c = S.stored(Q.classified(spark, sf).select("corpusid", "start", "paper_len", "sec_label_extended", F.length("section_text").cast("bigint").alias("section_chars"), begins))
    metrics = C.paper_metrics(Q.lengths(spark, sf, c))
    return B.answered(c, _result_lines(c), metrics).select("custom_id", "paper_id", "start", "sec_label_extended", "label", "confidence", "n_sections", *Q.r6("longest_section_percent"))


# --- annotation store and participants ---------------------------------------------------------------


@query(with_(Q._ASSIGNED, "SELECT p.paper_id, count(DISTINCT a.annotator_id) AS n_annotations FROM (SELECT unnest(range(0, 1200)) AS paper_id) p LEFT JOIN assigned a ON a.paper_id = p.paper_id AND a.completed GROUP BY 1"))
def annotation_counts(spark, sf):
    return A.annotation_counts(spark.range(1200).select(F.col("id").alias("paper_id")), Q.assigned(spark, sf))


@query(with_(Q._ASSIGNED, "SELECT paper_id, assigned_at, row_number() OVER (ORDER BY assigned_at, paper_id) AS place FROM assigned WHERE annotator_id = 7"))
def papers_of_annotator(spark, sf):
    """In order of assignment; the place shows it."""
    return A.papers_of(Q.assigned(spark, sf), 7).select("paper_id", "assigned_at").withColumn("place", (F.monotonically_increasing_id() + 1).cast("bigint"))


@query("SELECT 'age' AS \"column\", round(avg(x), 2) AS mean, round(stddev_samp(x), 2) AS std, min(x) AS min, max(x) AS max, count(x) AS count FROM (SELECT try_cast(CASE WHEN c_custkey % 10 = 0 THEN 'DATA_EXPIRED' ELSE (18 + c_custkey % 60)::VARCHAR END AS DOUBLE) AS x FROM customer WHERE c_custkey % 3 = 1)")
def pending_participants(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    status = F.when(F.col("c_custkey") % 3 == 1, D.PENDING).when(F.col("c_custkey") % 3 == 2, "APPROVED")
    age = F.when(F.col("c_custkey") % 10 == 0, "DATA_EXPIRED").otherwise((18 + F.col("c_custkey") % 60).cast("string"))
    return D.numeric_stats(D.with_status(c.select(status.alias("Status"), age.alias("age"))), ["age"])


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(trim(html), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#039;'), chr(10), '<br />' || chr(10)) AS escaped FROM pages")
def escaped_markup(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", X.escape_markup(F.col("html")).alias("escaped"))


# --- agreement of each pair of raters ------------------------------------------------------------------

_PAIRS = {"human_human": ("human", "human"), "human_llm": ("human", "llm"), "human_classifier": ("human", "classifier"), "llm_classifier": ("llm", "classifier")}


def _each_rating(spark, sf) -> DataFrame:
    item = F.concat_ws("-", "paper_id", "section_idx").alias("item")
    h = S.stored(Q.heads(spark, sf))  # used three times
    human = Q.valid_votes(spark, sf, h).select(item, F.col("annotator_id").cast("string").alias("annotator"), "label", F.lit("human").alias("kind"))
    llm = E.top_label(Q.llm_runs(spark, sf, h)).select(item, F.lit("llm").alias("annotator"), "label", F.lit("llm").alias("kind"))
    c = Q.classified(spark, sf, with_text=False).select("corpusid", "start", F.col("sec_label_extended").alias("label")).where("label is not null")
    own = h.join(c, ["corpusid", "start"]).select(F.concat_ws("-", "corpusid", "i").alias("item"), F.lit("classifier").alias("annotator"), "label", F.lit("classifier").alias("kind"))
    return human.unionByName(llm).unionByName(own)


_EACH_SQL = f"""{CLASSIFIED_SQL},
{Q.VOTES_SQL[len(PAPERS_SQL) + 2 :]},
{Q.LLM_SQL},
{Q._TOP_SQL},
each_ AS (SELECT paper_id || '-' || section_idx AS item, annotator_id::VARCHAR AS annotator, label, 'human' AS kind FROM valid
  UNION ALL SELECT paper_id || '-' || section_idx, 'llm', label, 'llm' FROM top WHERE rn = 1
  UNION ALL SELECT h.corpusid || '-' || h.i, 'classifier', c.sec_label_extended, 'classifier' FROM heads h JOIN classified c USING (corpusid, start) WHERE c.sec_label_extended IS NOT NULL),
pair_ AS (SELECT unnest({list(_PAIRS)}) AS pair, unnest({[a for a, _ in _PAIRS.values()]}) AS a, unnest({[b for _, b in _PAIRS.values()]}) AS b),
held AS (SELECT pair, item, a, b FROM pair_ JOIN each_ e ON e.kind IN (a, b) GROUP BY ALL
  HAVING (a <> b AND count(DISTINCT kind) = 2) OR (a = b AND count(DISTINCT annotator) >= 2)),
paired AS (SELECT h.pair, e.item, e.annotator, e.label FROM held h JOIN each_ e ON e.item = h.item AND e.kind IN (h.a, h.b)),
both_options AS (SELECT 'A' AS option, * FROM paired WHERE label NOT IN {Q._labels(V.UNSUPPORTED)} UNION ALL SELECT 'B', * FROM paired),
cells_ AS (SELECT option, pair, item, label, count(*) AS n FROM both_options GROUP BY ALL),
units_ AS (SELECT option, pair, item, sum(n) AS m, sum(n * n) AS s FROM cells_ GROUP BY ALL HAVING sum(n) > 1),
o_ AS (SELECT option, pair, sum((m * m - s) / (m - 1)) / sum(m) AS d, sum(m) AS n FROM units_ GROUP BY ALL),
e_ AS (SELECT option, pair, sum(n * n) AS squares FROM (SELECT option, pair, label, sum(n) AS n FROM cells_ SEMI JOIN units_ USING (option, pair, item) GROUP BY ALL) GROUP BY ALL),
k_ AS (SELECT option, pair, count(DISTINCT annotator) AS raters, count(DISTINCT item) AS units FROM both_options GROUP BY ALL)"""


@query(with_(_EACH_SQL, "SELECT option, pair, raters, units, round(1 - d / nullif((n * n - squares) / (n * (n - 1)), 0), 6) AS alpha FROM k_ LEFT JOIN o_ USING (option, pair) LEFT JOIN e_ USING (option, pair)"))
def krippendorff_pairs(spark, sf):
    """All four pairs of raters, without unsupported labels (A) and with all labels (B)."""
    out = E.pair_alphas(_each_rating(spark, sf), _PAIRS, {"A": V.UNSUPPORTED, "B": ()})
    return out.select("option", "pair", "raters", "units", *Q.r6("alpha"))
