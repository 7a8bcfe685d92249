"""Language identification by Bayesian fusion of evidence.

For each page, log P(language) is the sum of

* the text's likelihood: hashed byte trigrams (A-Z lower-cased) under each
  language, learned from a bounded sample of ``documents`` with their ``lang``;
* the declared markup language (``<html lang>``): P(declared | language),
  counted over all pages against what their texts say;
* the prior of the host: its pages' languages, smoothed towards those of its
  address suffix (last label), these towards those of all pages.  The page
  itself is left out of its host's counts, so it can't vouch for itself.

Counts are grouped sums of the texts' posteriors over all pages; a host or
suffix with a third of all pages is summed map-side first.  The trigram
likelihood is tempered, since neighbouring trigrams are not independent.

Defined cases: a null or empty page has no text and no declaration and gets the
language of its host's prior; a null url or one without ``://`` has the host ''
and suffix ''; repeated rows are counted and judged alike; without any sample
there is no language and the result is null with confidence 0; ties go to the
language first in order; a page of any length is read whole; an empty table gives
an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _symbols as S
from ._store import Kept
from .url_filter import host_and_path

SAMPLE = 2000
SAMPLE_BYTES = 1 << 14
BUCKETS = 1 << 16
TEMPER = 0.5
SMOOTH_HOST, SMOOTH_SUFFIX, SMOOTH_DECLARED = 8.0, 20.0, 2.0
_TAGS = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"
_DECLARED = r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]+)"""


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of each text and their offsets (none across texts)."""
    x = S._LOWER[raw].astype(np.uint64)
    n = np.maximum(np.diff(offsets) - 2, 0)
    off = np.concatenate([[0], np.cumsum(n)])
    if not off[-1]:
        return np.zeros(0, np.int64), off
    at = np.arange(off[-1]) + np.repeat(offsets[:-1] - off[:-1], n)
    return (S.mix((x[at] << np.uint64(16)) | (x[at + 1] << np.uint64(8)) | x[at + 2]) % np.uint64(BUCKETS)).astype(np.int64), off


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their (BUCKETS, languages) log likelihoods.

    Every language that any document has is one; each learns from its share of
    the sample, so from texts of its own, of which a very long one gives its
    first ``SAMPLE_BYTES`` characters.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.substring(F.col(text_col).cast("string"), 1, SAMPLE_BYTES).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    each = F.greatest(F.lit(1), F.floor(F.lit(sample) / F.count(F.lit(1)).over(Window.partitionBy())))
    # about twice the share, thinned out by hash where the rows are, so that no language meets in one task
    sizes = sizes.withColumn("each", each).withColumn("every", F.greatest(F.lit(1), F.floor(F.col("n") / (2 * F.col("each")))).cast("long"))
    rows = rows.join(F.broadcast(sizes), "lang").where(F.pmod("h", "every") == 0)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "text"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= F.col("each")).select("lang", "text").collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.full((BUCKETS, len(langs)), 0.5)
    for r in rows:
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        counts[:, langs.index(r["lang"])] += np.bincount(trigrams(raw, np.array([0, len(raw)]))[0], minlength=BUCKETS)
    return langs, np.log(counts / counts.sum(0, keepdims=True)).astype(np.float32)


def _likelihoods(table: np.ndarray):
    def run(batches):
        for b in batches:
            raw, off = S.flat(b.column("text"))
            for lo, hi in S.runs_of(off):
                g, o = trigrams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                total = np.zeros((hi - lo, table.shape[1]))
                some = np.flatnonzero(np.diff(o))
                if len(some):
                    total[some] = np.add.reduceat(table[g].astype(np.float64), o[some], axis=0) * TEMPER
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * table.shape[1]), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("row").slice(lo, hi - lo), lists], names=["row", "ll"])

    return run


def posterior(logs: F.Column) -> F.Column:
    """Normalised probabilities of an array of logarithms."""
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def identify(pages: DataFrame, docs: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang", doc_id_col: str = "doc_id") -> DataFrame:
    """One row per page: id, lang, confidence, text_lang (by the text alone) and declared."""
    langs, table = fit(docs, text_col=text_col, lang_col=lang_col, id_col=doc_id_col)
    page = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    if not langs:
        return page.select(F.col("id").alias(id_col), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"))
    k = len(langs)
    host, _ = host_and_path(F.col("url"))
    declared = F.lower(F.nullif(F.regexp_extract("html", _DECLARED, 1), F.lit("")))
    page = page.select(F.struct("id", host.alias("host"), declared.alias("declared")).alias("row"), F.regexp_replace("html", _TAGS, " ").alias("text"))
    kind = page.schema["row"].dataType.simpleString()
    seen = Kept(page.mapInArrow(_likelihoods(table), f"row {kind}, ll array<double>").select("row.*", "ll"), "language-likelihoods").df
    seen = seen.withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0)).withColumn("p", posterior(F.col("ll")))
    each = [F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(k)]

    def counts(of: DataFrame, name: str) -> DataFrame:
        return of.withColumn(name, F.array(*[F.coalesce(f"n{i}", F.lit(0.0)) for i in range(k)])).drop(*[f"n{i}" for i in range(k)])

    def smoothed(n: F.Column, parent: F.Column, weight: float) -> F.Column:
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, parent, lambda x, q: (x + F.lit(weight) * q) / (total + F.lit(weight)))

    every = counts(seen.agg(*each), "all_n").select(smoothed(F.col("all_n"), F.array(*[F.lit(1.0 / k)] * k), 1.0).alias("all_p"))
    by_suffix = counts(seen.groupBy("suffix").agg(*each), "suffix_n").join(F.broadcast(every)).select("suffix", smoothed(F.col("suffix_n"), F.col("all_p"), SMOOTH_SUFFIX).alias("suffix_p"))
    # a table of its own: so both sides of the join below are plain shuffles, and Spark splits a hot host's pages among tasks
    by_host = Kept(counts(seen.groupBy("host", "suffix").agg(*each), "host_n").join(by_suffix, "suffix").select("host", "host_n", "suffix_p"), "language-hosts").df
    # P(declared | language), smoothed towards the declaration's share in all pages
    said = counts(seen.where("declared is not null").groupBy("declared").agg(*each), "said")
    totals = said.agg(*[F.sum(F.col("said")[i]).alias(f"t{i}") for i in range(k)]).select(F.array(*[F.coalesce(f"t{i}", F.lit(0.0)) for i in range(k)]).alias("totals"))
    said = said.join(F.broadcast(totals))
    share = F.aggregate("said", F.lit(0.0), lambda a, x: a + x) / F.aggregate("totals", F.lit(0.0), lambda a, x: a + x)
    said = said.select("declared", F.zip_with("said", "totals", lambda x, t: F.ln((x + F.lit(SMOOTH_DECLARED) * share) / (t + F.lit(SMOOTH_DECLARED)))).alias("said_ll"))
    own = F.zip_with("host_n", "p", lambda n, x: F.greatest(n - x, F.lit(0.0)))
    joined = seen.join(by_host, "host").join(said, "declared", "left")
    prior = smoothed(own, F.col("suffix_p"), SMOOTH_HOST)
    nothing = F.array(*[F.lit(0.0)] * k)
    logs = F.zip_with(F.zip_with("ll", prior, lambda x, q: x + F.ln(q)), F.coalesce("said_ll", nothing), lambda x, y: x + y)
    out = joined.select("id", "declared", posterior(logs).alias("q"), "p", F.array_max("ll").alias("most"), F.array_min("ll").alias("least"))
    names = F.array(*[F.lit(x) for x in langs])
    best = names[F.array_position("q", F.array_max("q")).cast("int") - 1]
    text_best = F.when(F.col("most") > F.col("least"), names[F.array_position("p", F.array_max("p")).cast("int") - 1])
    return out.select(F.col("id").alias(id_col), best.alias("lang"), F.array_max("q").alias("confidence"), text_best.alias("text_lang"), "declared")
