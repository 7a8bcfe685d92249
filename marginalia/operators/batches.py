"""Annotation requests for a language model: prompts, request rows, packing into files, responses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.files import stored
from .sampling import annotatable_fillna, ids_of, section_ordinal

SNIPPET_TOKENS = 300
FILE_TOKENS = 1_800_000


def snippet(text: Column, limit: int = SNIPPET_TOKENS) -> Column:
    """The first ``limit`` white-space tokens, joined by spaces (a native stand-in for a BPE tokenizer)."""
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda x: x != ""), 1, limit), " ")


def tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).cast("bigint")


def _encoding(ranks_path: str, pattern: str):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(text: Column, ranks_path: str, pattern: str) -> Column:
    """Token counts by a BPE vocabulary file that every worker can read (given by the caller), as a pandas UDF."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        enc = _encoding(ranks_path, pattern)
        return s.map(lambda x: 0 if x is None else len(enc.encode_ordinary(x)))

    return count(text)


def bpe_snippet(text: Column, ranks_path: str, pattern: str, limit: int = SNIPPET_TOKENS) -> Column:
    """The text of the first ``limit`` tokens by a BPE vocabulary file; a shorter text as it is."""

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        enc = _encoding(ranks_path, pattern)

        def one(x: str | None) -> str | None:
            if x is None:
                return None
            t = enc.encode_ordinary(x)
            return x if len(t) <= limit else enc.decode(t[:limit])

        return s.map(one)

    return cut(text)


def prompt(rows: DataFrame) -> DataFrame:
    """``prompt``: header, context and snippet in one fixed template."""
    text = F.concat(
        F.lit("Headers before: "), F.concat_ws(" | ", "previous_headers"), F.lit("\nHeader: "), F.coalesce("extracted", F.lit("")),
        F.lit("\nHeaders after: "), F.concat_ws(" | ", "next_headers"), F.lit("\nText: "), snippet(F.col("section_text")),
    )
    return rows.withColumn("prompt", text)


def request(custom_id: Column, text: Column, model: str = "model") -> Column:
    """One request line as JSON."""
    content = F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text")))
    message = F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))
    body = F.struct(F.lit(model).alias("model"), message.alias("input"), F.lit(True).alias("store"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), body.alias("body")))


def packing_ranges(requests: DataFrame, limit: int, files: int) -> DataFrame:
    """(corpusid, pack): papers in order of id, a range ending once it holds the tokens of ``files`` files.

    The running sum is taken over blocks of 65,536 ids and inside each block, so
    no task orders all papers.
    """
    per = requests.groupBy("corpusid").agg(F.sum("n_tokens").alias("t")).withColumn("block", F.shiftright("corpusid", 16))
    ahead = F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = per.groupBy("block").agg(F.sum("t").alias("s")).select("block", ahead.alias("ahead"))
    inside = F.coalesce(F.sum("t").over(Window.partitionBy("block").orderBy("corpusid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("inside", inside).join(blocks, "block").select("corpusid", F.floor((F.col("ahead") + F.col("inside")) / (limit * files)).cast("bigint").alias("pack"))


def pack(requests: DataFrame, limit: int = FILE_TOKENS, files: int = 64) -> DataFrame:
    """requests with ``batch``, the number of their file from 1 on; a file is closed before it would pass ``limit``.

    Greedy packing in order of paper and index, as each file depends on the one
    before.  So that a task stays bounded, papers are dealt to ranges of about
    ``files`` files' tokens; a range begins a new file, and files are numbered
    through over all ranges.  A request over the limit is a file of its own.
    requests: corpusid, section_idx, n_tokens and any others, such as ``line``.
    They are computed and written once; only their sizes go through the packer.
    """
    kept = stored(requests.withColumn("_row", F.monotonically_increasing_id()))  # used three times
    sizes = kept.select("corpusid", "section_idx", "n_tokens", "_row")
    out = StructType([StructField("_row", LongType()), StructField("pack", LongType()), StructField("batch", LongType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["corpusid", "section_idx"], kind="stable")
        batch, used, numbers = 1, 0, []
        for n in pdf["n_tokens"]:
            if used and used + n > limit:
                batch, used = batch + 1, 0
            used += n
            numbers.append(batch)
        return pdf.assign(batch=numbers)[["_row", "pack", "batch"]]

    dealt = sizes.join(packing_ranges(sizes, limit, files), "corpusid")
    packed = stored(dealt.groupBy("pack").applyInPandas(fold, out))  # used twice
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = packed.groupBy("pack").agg(F.max("batch").alias("n")).select("pack", ahead.alias("ahead"))
    numbered = packed.join(ranges, "pack").select("_row", (F.col("batch") + F.col("ahead")).alias("batch"))
    return kept.join(numbered, "_row").drop("_row")


ENVELOPE = "struct<custom_id:string,error:string,response:struct<body:struct<output:array<struct<type:string,content:array<struct<text:string>>>>>>>"


def response(line: Column) -> Column:
    """{custom_id, label, confidence} of a result line; null label for errors and unreadable lines."""

    def once(x: Column, f) -> Column:  # as a lambda's argument, x is parsed once however often f names it
        return F.transform(F.array(x), f)[0]

    def read(e: Column) -> Column:
        message = F.filter(e["response"]["body"]["output"], lambda x: x["type"] == "message")
        text = F.try_element_at(F.try_element_at(message, F.lit(1))["content"], F.lit(1))["text"]
        ok = e["error"].isNull()
        return once(F.from_json(text, "struct<label:string,confidence:string>"), lambda a: F.struct(e["custom_id"].alias("custom_id"), F.when(ok, a["label"]).alias("label"), F.when(ok, a["confidence"]).alias("confidence")))

    return once(F.from_json(line, ENVELOPE), read)


def requested(sample: DataFrame) -> DataFrame:
    """The sample's rows that were asked about, each with the custom_id of its request."""
    return with_ids(section_ordinal(annotatable_fillna(sample)))


def with_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("custom_id", ids_of(rows))


def answers(lines: DataFrame) -> DataFrame:
    """(custom_id, label, confidence) of result lines (line, file, pos): of readable answers to one request the last, by file and place."""
    r = lines.select("file", "pos", response(F.col("line")).alias("r")).select("file", "pos", "r.*").where("custom_id is not null and label is not null")
    last = F.row_number().over(Window.partitionBy("custom_id").orderBy(F.desc("file"), F.desc("pos")))
    return r.withColumn("rn", last).where("rn = 1").select("custom_id", "label", "confidence")


def answered(sample: DataFrame, lines: DataFrame, metrics: DataFrame) -> DataFrame:
    """Requests joined to their answers on custom_id, with the paper's metrics."""
    asked = requested(sample).select("custom_id", F.col("corpusid").alias("paper_id"), "start", "sec_label_extended")
    paper = metrics.select(F.col("corpusid").alias("paper_id"), "longest_section_percent", "n_sections")
    return asked.join(answers(lines), "custom_id").join(paper, "paper_id", "left")
