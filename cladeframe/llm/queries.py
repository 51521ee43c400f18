"""The queries of the operators over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import decontaminate, html_text, licenses, line_dedup, lm_score, mixing, near_dedup, pii, quality, secrets
from cladeframe.llm._common import load


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(load(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(load(spark, sf_dir, "pages"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"), words=2)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(load(spark, sf_dir, "documents")).drop("distance")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lattice_scores(load(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_units(load(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(load(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_html, op3_near_duplicates, op4_quality, op5_mixing, op6_lm_score, op7_line_dedup, op8_pii, op9_decontamination, op10_licenses)}

#: op3: every pair of documents with a common shingle, then reachability. Compares all pairs, which DuckDB can at small sizes.
_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w
), n AS (
  SELECT doc_id, sh, len(sh) AS n FROM s
), e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM n a JOIN n b
    ON a.doc_id < b.doc_id AND a.n > 0 AND b.n > 0 AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  WHERE 100 * len(list_intersect(a.sh, b.sh)) >= 80 * (a.n + b.n - len(list_intersect(a.sh, b.sh)))
), u AS (
  SELECT x, y FROM e UNION SELECT y, x FROM e
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, u.y FROM r JOIN u ON r.other = u.x
), c AS (
  SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)
"""

#: op9: windows as strings; a position is hit if a window occurrence covers it.
_OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(ws[p : p + least(13, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)
), k AS (
  SELECT DISTINCT k FROM win
), pos AS (
  SELECT doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') AS win
  FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS p FROM d, k WHERE len(ws) >= k)
), hit AS (
  SELECT DISTINCT doc_id, pos.k, p, item_id FROM pos JOIN win ON pos.k = win.k AND pos.win = win.win
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: op7: lines and sentences as rows, keys as strings; a short sentence's key are the last 8 words of all sentences so far.
_OP7 = r"""
WITH l AS (
  SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), p AS (
  SELECT doc_id, i, j, part, head + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM (SELECT doc_id, i, pos + length(regexp_extract(line, '^[.!?]*')) AS head, unnest(regexp_extract_all(line, '[^.!?]+[.!?]*')) AS part, generate_subscripts(regexp_extract_all(line, '[^.!?]+[.!?]*'), 1) AS j FROM l)
), w AS (
  SELECT *, regexp_extract_all(lower(part), '\S+') AS words FROM (SELECT * FROM p UNION ALL SELECT doc_id, i, 0, line, pos FROM l) WHERE regexp_matches(part, '\S')
), n AS (
  SELECT *, sum(CASE WHEN j > 0 THEN len(words) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i, j) AS upto FROM w
), every AS (
  SELECT doc_id, flatten(list(words ORDER BY i, j)) AS stream FROM w WHERE j > 0 GROUP BY doc_id
), k AS (
  SELECT n.doc_id, i, j, pos + length(part) - length(regexp_replace(part, '^\s+', '')) AS a, pos + length(regexp_replace(part, '\s+$', '')) AS b,
    CASE WHEN j = 0 OR len(words) >= 8 THEN array_to_string(words, ' ') WHEN upto >= 8 THEN array_to_string(stream[CAST(upto AS BIGINT) - 7 : CAST(upto AS BIGINT)], ' ') END AS unit
  FROM n LEFT JOIN every USING (doc_id)
), u AS (
  SELECT doc_id, i, j, a, b, coalesce(nullif(regexp_replace(unit, '[.!?]+$', ''), ''), unit) AS unit FROM k WHERE unit IS NOT NULL
), units AS (
  SELECT u.*, row_number() OVER (PARTITION BY u.unit ORDER BY u.doc_id, u.i, u.j) > 1 AS late FROM u LEFT JOIN u AS whole ON whole.doc_id = u.doc_id AND whole.i = u.i AND whole.j = 0
  WHERE u.j = 0 OR u.unit <> whole.unit
), gone AS (
  SELECT s.* FROM units s JOIN units whole ON whole.doc_id = s.doc_id AND whole.i = s.i AND whole.j = 0 WHERE s.late AND (s.j = 0 OR NOT whole.late)
)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_units FROM units GROUP BY doc_id) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n_removed, string_agg(concat(CAST(a AS BIGINT), ':', CAST(b AS BIGINT)), ',' ORDER BY i, j) AS removed FROM gone GROUP BY doc_id) USING (doc_id)
"""

#: op2: the given pages have one article each, without lists, frames or names inside; its blocks are what stands between its tags of blocks.
_OP2 = r"""
WITH b AS (
  SELECT page_id, i, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(part, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
    FROM (SELECT page_id, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h[1-6]|ul|ol|li|div|table|tr|td|blockquote|pre|section)(?:\s[^>]*)?>') AS parts FROM pages))
), t AS (
  SELECT page_id, string_agg(text, chr(10) ORDER BY i) AS text FROM b WHERE text <> '' GROUP BY page_id
)
SELECT p.page_id, p.url, coalesce(t.text, '') AS text, CAST(length(coalesce(t.text, '')) AS BIGINT) AS n_chars FROM pages p LEFT JOIN t USING (page_id)
"""

ORACLE_SQL = {"op2_html": _OP2, "op3_near_duplicates": _OP3, "op7_line_dedup": _OP7, "op9_decontamination": _OP9}
