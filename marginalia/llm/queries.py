"""The queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import find_leaks
from .exact_topk import exact_topk
from .language_id import identify
from .mix_sources import mix_sources
from .near_dedup import near_dedup
from .quality import quality_scores
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .suffix_tree_lm import lm_scores
from .url_filter import url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_documents(spark, sf_dir), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_documents(spark, sf_dir))


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), _documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_documents(spark, sf_dir), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_exact_topk, op3_url_filter, op4_decontaminate, op5_quality, op6_substring_dedup, op7_near_dedup, op8_suffix_tree_lm, op9_language_id, op10_suffix_dedup)}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
nth AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS w,
               row_number() OVER (ORDER BY source IS NULL, encode(source)) AS nth FROM src),
lvl AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER before, 0) * 2.0::DOUBLE)
               / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level,
               row_number() OVER (ORDER BY source_size::DOUBLE / w, nth) AS rank
        FROM nth WINDOW before AS (ORDER BY source_size::DOUBLE / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (SELECT *, (SELECT arg_min(level, rank) FROM lvl WHERE source_size * 2.0::DOUBLE > level * w) AS top FROM lvl),
t AS (SELECT source, source_size, CASE WHEN top IS NULL THEN source_size * 2.0::DOUBLE ELSE least(source_size * 2.0::DOUBLE, top * w) END AS target FROM tgt),
cue AS (SELECT d.*, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
times AS (SELECT size, (upto + k * source_size)::DOUBLE / nullif(target, 0) AS v FROM cue, (VALUES (0), (1)) r(k) WHERE size > 0),
cum AS (SELECT v, sum(size) OVER (ORDER BY v) AS s FROM times),
cut AS (SELECT max(v) AS v FROM cum WHERE s <= (SELECT sum(size) * 1.5::DOUBLE FROM d))
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN upto::DOUBLE / nullif(target, 0) <= cut.v THEN size ELSE 0 END
          + CASE WHEN (upto + source_size)::DOUBLE / nullif(target, 0) <= cut.v THEN size ELSE 0 END AS BIGINT) AS taken
FROM cue, cut
"""

OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""

OP3_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hit AS (SELECT p.page_id, arg_max({'rule': rules.host || rules.path, 'verdict': rules.verdict}, len(rules.host || rules.path)) AS best
        FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN hit USING (page_id)
"""

OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM win SEMI JOIN rep USING (h)),
per AS (SELECT rid, list(j) AS js FROM gone GROUP BY rid),
wd AS (SELECT rid, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT wd.rid, count(*) AS n_kept, string_agg(word, ' ' ORDER BY wd.j) AS body FROM wd ANTI JOIN gone ON wd.rid = gone.rid AND wd.j = gone.j GROUP BY wd.rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d)),
rep AS (SELECT m FROM win GROUP BY m HAVING count(*) > 1),
hit AS (SELECT rid, i, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 400, true)::INT AS opens FROM win SEMI JOIN rep USING (m)),
run AS (SELECT rid, i, sum(opens) OVER (PARTITION BY rid ORDER BY i) AS nth FROM hit),
span AS (SELECT rid, nth, min(i) AS s, max(i) + 400 AS e FROM run GROUP BY rid, nth),
gap AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS f FROM span),
per AS (SELECT rid, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(e - s) AS BIGINT) AS n_removed, max(e) AS last, string_agg(substr(h, 2 * f + 1, 2 * (s - f)), '' ORDER BY s) AS body FROM gap JOIN d USING (rid) GROUP BY rid)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(body, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN per USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_exact_topk": OP2_SQL, "op3_url_filter": OP3_SQL, "op6_substring_dedup": OP6_SQL, "op10_suffix_dedup": OP10_SQL}
