"""SQL of the section rules, stage by stage, written with windows and joins (the oracle's own way)."""

from __future__ import annotations

from ..functions import vocabulary as V
from .papers import PAPERS_SQL


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(labels) -> str:
    return "(" + ", ".join(_text(x) for x in labels) + ")"


EXACT_SQL = "CASE " + " ".join(f"WHEN extracted IN {_in(sorted(p))} THEN {_text(k)}" for k, p in V.PHRASES.items()) + " END"
PATTERN_SQL = "CASE " + " ".join(f"WHEN regexp_matches(extracted, {_text(V.word_pattern(p))}) THEN {_text(k)}" for k, p in V.PATTERNS) + " END"
ALTERNATIVE_SQL = "CASE " + " ".join(f"WHEN extracted IN {_in(sorted(p))} THEN {_text(k)}" for k, p in V.ALTERNATIVES.items()) + " END"

HEADERS_SQL = f"""{PAPERS_SQL},
bounds AS (SELECT h.corpusid, h.i, h.start, h.start + length(h.header) AS end_header, h.section_n, p.text, CAST(length(p.text) AS BIGINT) AS paper_len,
  coalesce(lead(h.start) OVER (PARTITION BY h.corpusid ORDER BY h.start), length(p.text)) AS end_section FROM heads h JOIN papers p USING (corpusid)),
cut AS (SELECT corpusid, i, start, CAST(end_header AS BIGINT) AS end_header, section_n, paper_len, CAST(end_section AS BIGINT) AS end_section,
  substr(text, CAST(start + 1 AS BIGINT), end_header - start) AS txt_header, substr(text, CAST(start + 1 AS BIGINT), end_section - start) AS section_text
  FROM bounds WHERE end_section >= start),
sec AS (SELECT *, nullif(regexp_extract(txt_header, {_text(V.LIST_MARKER)}, 1), '') AS section_number,
  lower(regexp_replace(regexp_replace(txt_header, {_text(V.LIST_MARKER)}, ''), '^\\s+|\\s+$', '', 'g')) AS extracted FROM cut)"""

LABELS_SQL = f"""{HEADERS_SQL},
lab AS (SELECT *, {ALTERNATIVE_SQL} AS section_alt_label, {EXACT_SQL} AS exact_label, {PATTERN_SQL} AS pattern_label FROM sec),
mapped AS (SELECT *, coalesce(exact_label, pattern_label) AS sec_map FROM lab)"""

CLASSIFIED_SQL = f"""{LABELS_SQL},
core AS (SELECT corpusid, max(start) AS last_core FROM mapped WHERE sec_map IN {_in(V.CORE)} GROUP BY corpusid),
ended AS (SELECT m.*, coalesce(c.last_core, 0) AS last_core_start,
  CASE WHEN m.sec_map IN {_in(V.CORE)} OR m.start > coalesce(c.last_core, 0) THEN m.sec_map END AS sec_label FROM mapped m LEFT JOIN core c USING (corpusid)),
topped AS (SELECT *, coalesce(regexp_matches(section_n, {_text(V.TOP_NUMBER + "$")}) OR regexp_matches(section_number, {_text(V.TOP_ROMAN + "$")}) OR sec_map IN {_in(V.CORE)}, false) AS top_header,
  lag(sec_label) OVER (PARTITION BY corpusid ORDER BY start) AS previous_label FROM ended),
dev AS (SELECT *, CASE WHEN sec_label IS NULL AND top_header AND previous_label IN ('introduction', 'lit_review') THEN 'development' ELSE sec_label END AS sec_label_new FROM topped),
classified AS (SELECT *, last_value(sec_label_new IGNORE NULLS) OVER (PARTITION BY corpusid ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec_label_extended FROM dev)"""

AGGREGATED_SQL = f"""{CLASSIFIED_SQL},
aggregated AS (SELECT corpusid, sec_label_extended, string_agg(section_text, ' ' ORDER BY start) AS section_text, min(start) AS start, max(paper_len) AS paper_len FROM classified GROUP BY ALL),
sized AS (SELECT *, CAST(length(section_text) AS BIGINT) AS section_length FROM aggregated),
adjusted AS (SELECT *, CAST(paper_len - sum(CASE WHEN sec_label_extended IN {_in(V.NOT_LENGTH)} THEN section_length ELSE 0 END) OVER (PARTITION BY corpusid) AS BIGINT) AS adjusted_paper_len FROM sized),
shares AS (SELECT *, CASE WHEN adjusted_paper_len > 0 THEN section_length::DOUBLE / adjusted_paper_len::DOUBLE * 100 END AS perc_of_new_total FROM adjusted),
relevant AS (SELECT *, count(*) OVER (PARTITION BY corpusid) AS n_sections, max(perc_of_new_total) OVER (PARTITION BY corpusid) AS max_perc FROM shares WHERE sec_label_extended IN {_in(V.RELEVANT)})"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"
