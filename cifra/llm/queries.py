"""The subpackage's queries over the whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cifra.llm import chat_format, cover_dedup, decontam, mixing, pii, quality_classifier, quality_rules, simhash, suffix_dedup, url_filter
from cifra.llm.common import table
from cifra.sources import io

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.spread(table(spark, sf_dir, "documents"))


def op1_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted(chat_format.other_replies(chat_format.gathered(chat_format.neighbours(table(spark, sf_dir, "conversations")))))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), with_text=False)


def op3_subset_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "passes")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op5_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup.remove_repeats(documents(spark, sf_dir), with_text=False)


def op6_candidate_boosting_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(documents(spark, sf_dir))


def op7_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)


def op8_deletion_variant_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(documents(spark, sf_dir))


def op9_positional_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("item_ids", "near_ids")


def op10_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_preference_formatting, op2_suffix_array_dedup, op3_subset_sum_mixing, op4_url_filters, op5_difference_cover_dedup, op6_candidate_boosting_pii, op7_line_first_quality, op8_deletion_variant_simhash, op9_positional_index_decontamination, op10_fourier_quality)}


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH turns AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, coalesce(conv_id % 2 = 0, true) AS is_chosen, conv_id,
    {'turn': turn, 'role': role, 'text': text} AS t, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone
  FROM conversations),
gathered AS (
  SELECT min(conv_id) FILTER (is_chosen) AS c_id, min(conv_id) FILTER (NOT is_chosen) AS r_id,
    coalesce(list(t ORDER BY t.turn NULLS FIRST, t.role NULLS FIRST, t.text NULLS FIRST) FILTER (is_chosen), []) AS c,
    coalesce(list(t ORDER BY t.turn NULLS FIRST, t.role NULLS FIRST, t.text NULLS FIRST) FILTER (NOT is_chosen), []) AS r
  FROM turns GROUP BY pair_id, lone),
sided AS (
  SELECT c_id AS pair_id, r_id AS rejected_id, c, r AS other FROM gathered UNION ALL SELECT r_id, c_id, r, c FROM gathered),
replies AS (
  SELECT *, coalesce(list_max(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant')), 0) AS own_last,
    list_max(list_filter(range(1, len(other) + 1), lambda i: other[i].role = 'assistant')) AS other_last
  FROM sided WHERE len(c) > 0),
pairs AS (
  SELECT pair_id, pair_id AS chosen_id, rejected_id, c, list_transform(range(1, len(c) + 1), lambda i: {'turn': c[i].turn, 'role': c[i].role,
    'text': CASE WHEN i <> own_last THEN c[i].text WHEN other_last IS NULL THEN '' ELSE other[other_last].text END}) AS r
  FROM replies),
cut AS (
  SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(c), len(r)) + 1), lambda i: i <= len(c) AND i <= len(r)
      AND c[i].role IS NOT DISTINCT FROM r[i].role AND c[i].text IS NOT DISTINCT FROM r[i].text), false) - 1,
    greatest(len(c), len(r))) AS k
  FROM pairs),
heads AS (
  SELECT *, list_transform(c, lambda t: '<|' || replace(coalesce(t.role, 'unknown'), '<|', '< |') || '|>' || chr(10)) AS ch,
    list_transform(r, lambda t: '<|' || replace(coalesce(t.role, 'unknown'), '<|', '< |') || '|>' || chr(10)) AS rh,
    list_transform(c, lambda t: replace(coalesce(t.text, ''), '<|', '< |') || '<|end|>' || chr(10)) AS ct,
    list_transform(r, lambda t: replace(coalesce(t.text, ''), '<|', '< |') || '<|end|>' || chr(10)) AS rt
  FROM cut),
whole AS (
  SELECT *, list_transform(range(1, len(c) + 1), lambda i: ch[i] || ct[i]) AS cw, list_transform(range(1, len(r) + 1), lambda i: rh[i] || rt[i]) AS rw
  FROM heads)
SELECT pair_id, chosen_id, rejected_id, k AS n_prompt_turns, coalesce(array_to_string(cw[1:k], ''), '') AS prompt,
  coalesce(array_to_string(cw[k + 1:], ''), '') AS chosen,
  coalesce(array_to_string(list_transform(list_filter(range(k + 1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i:
    (length(array_to_string(cw[k + 1:i - 1], '')) + length(ch[i]))::VARCHAR || '-' || length(array_to_string(cw[k + 1:i], ''))::VARCHAR), ','), '') AS chosen_mask,
  coalesce(array_to_string(rw[k + 1:], ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(range(k + 1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i:
    (length(array_to_string(rw[k + 1:i - 1], '')) + length(rh[i]))::VARCHAR || '-' || length(array_to_string(rw[k + 1:i], ''))::VARCHAR), ','), '') AS rejected_mask
FROM whole
"""

OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
places AS (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM sized WHERE n >= 50),
windows AS (SELECT doc_id, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 100)) AS w FROM places),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE first < doc_id),
edges AS (SELECT doc_id, i AS pos, 1 AS step FROM hits UNION ALL SELECT doc_id, i + 50, -1 FROM hits),
steps AS (SELECT doc_id, pos, sum(step) AS step FROM edges GROUP BY ALL),
depth AS (SELECT doc_id, pos, sum(step) OVER (PARTITION BY doc_id ORDER BY pos) AS depth, step FROM steps),
marks AS (SELECT doc_id, pos, depth > 0 AS covered, coalesce(lag(depth) OVER (PARTITION BY doc_id ORDER BY pos), 0) > 0 AS before FROM depth),
starts AS (SELECT doc_id, pos, covered, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), pos) AS till FROM marks WHERE covered <> before),
spans AS (SELECT doc_id, list([pos, till] ORDER BY pos) AS s, sum(till - pos) AS removed, count(*) AS n_spans FROM starts WHERE covered GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN s IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(s) + 1), lambda k:
    substr(h, CAST(2 * (CASE WHEN k = 0 THEN 0 ELSE s[k][2] END) + 1 AS BIGINT),
      CAST(2 * ((CASE WHEN k = len(s) THEN n ELSE s[k + 1][1] END) - (CASE WHEN k = 0 THEN 0 ELSE s[k][2] END)) AS BIGINT))), '') END)) AS kept_sha256
FROM sized LEFT JOIN spans USING (doc_id)
"""

OP4 = f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce({LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest),
rules(rule, h, p, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
ruled AS (
  SELECT *, (SELECT max_by({{'rule': rule, 'verdict': verdict}}, length(rule)) FROM rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r
  FROM parts)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict,
  CASE WHEN regexp_matches(host, '(^|[^0-9a-z\\x{{80}}-\\x{{10FFFF}}])(adult|porn|xxx|sex|casino|poker|betting|pills|viagra|warez|torrent|malware|phishing|spam)([^0-9a-z\\x{{80}}-\\x{{10FFFF}}]|$)')
    OR regexp_matches(path, '(?s)^/(.*/)?wp-login\\.php$') OR starts_with(path, '/cgi-bin/') THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""

OP5 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS h FROM places),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM windows JOIN firsts USING (h) WHERE first < doc_id),
lists AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id),
flat AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d WHERE doc_id IN (SELECT doc_id FROM lists)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t FROM flat ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(CASE WHEN n IS NULL THEN coalesce(array_to_string(w, ' '), '') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item_places AS (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS s FROM item_places),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size),
found AS (SELECT doc_id, item_id, k, size FROM (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS s FROM doc_places) JOIN item_windows USING (size, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id),
flat AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d),
counts AS (SELECT term, count(*) AS n FROM flat GROUP BY term),
window_terms AS (SELECT DISTINCT item_id, k, unnest(w[k:k + size - 1]) AS term FROM item_places),
anchors AS (SELECT item_id, k, count(*) AS n_terms, min((coalesce(n, 0), term)) AS rarest FROM window_terms LEFT JOIN counts USING (term) GROUP BY item_id, k),
places AS (SELECT item_id, k, n_terms, doc_id, pos FROM anchors JOIN flat ON flat.term = rarest[2]),
near AS (SELECT item_id, p.doc_id FROM places p JOIN window_terms t USING (item_id, k) JOIN flat f ON f.doc_id = p.doc_id AND f.term = t.term AND f.pos BETWEEN p.pos - 26 AND p.pos + 26
  GROUP BY item_id, k, p.doc_id, p.pos, n_terms HAVING count(DISTINCT f.term) = n_terms),
near_items AS (SELECT doc_id, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near_ids FROM (SELECT DISTINCT doc_id, item_id FROM near) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_formatting": OP1, "op2_suffix_array_dedup": OP2, "op4_url_filters": OP4, "op5_difference_cover_dedup": OP5, "op9_positional_index_decontamination": OP9}
