"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelspark.llm import byte_bpe, conversations, fill_middle, fingerprint, lm, mixing, pieces, pii, quality_model, quality_rules, simhash, toxicity, url_filter
from reelspark.llm.common import read_table
from reelspark.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(read_table(spark, sf_dir, "documents"))


def op5_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects alone and at all, from a written ledger."""
    path = f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    return quality_rules.ablation(quality_rules.save_ledger(read_table(spark, sf_dir, "documents"), path))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_scores(read_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), url_filter.rule_list(spark))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(read_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokens(read_table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read_table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(read_table(spark, sf_dir, "conversations"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_middle(read_table(spark, sf_dir, "documents"), digests=True)


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op5_rule_ablation": op5_rule_ablation,
    "op6_lm_score": op6_lm_score,
    "op7_url_filter": op7_url_filter,
    "op8_quality_model": op8_quality_model,
    "op9_fingerprint": op9_fingerprint,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_conversations": op12_conversations,
    "op13_fill_middle": op13_fill_middle,
}

_LEDGER = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3))
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE k >= 2) GROUP BY doc_id
), m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM t JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)
), b AS (
  SELECT *, CAST(CAST(n_words < 50 AS INT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT) + 4 * CAST(10 * n_symbols > 3 * n_words AS INT) + 8 * CAST(n_lines >= 4 AND 2 * n_dup_lines > n_lines AS INT)
    + 16 * CAST(word_chars < 2 * n_words OR word_chars > 20 * n_words AS INT) + 32 * CAST(5 * n_upper > 3 * word_chars AS INT) AS BIGINT) AS failed FROM m
)
"""

#: One layer closed, and one turn read from it, over structs (cost, audit, text); null: not reached.
_INSERTED = "CASE WHEN {0} IS NOT NULL THEN {{'c': {0}.c + 2, 'a': {0}.a || 'I', 't': {0}.t || '{1}'}} END"
_OFFER = "CASE WHEN {0} IS NOT NULL AND {1} THEN {{'c': {0}.c + {2}, 'a': {0}.a || '{3}', 't': {0}.t || {4}}} END"


def _repair_sql() -> str:
    """Conversations damaged and repaired; a row of the search holds its four states."""
    least = lambda *xs: f"list_min(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))"
    u, a = "user:\n", "assistant:\n"
    # after one inserted turn, and after two
    one = lambda table: f"SELECT * EXCLUDE (p1, p2, p3), {least('p2', _INSERTED.format('p0', u), _INSERTED.format('p1', u), _INSERTED.format('p3', u))} AS q2, {least('p3', _INSERTED.format('p2', a))} AS q3, p1 FROM {table}"
    two = lambda table: f"SELECT * EXCLUDE (q2, q3, p1), p1, {least('q2', _INSERTED.format('p1', u), _INSERTED.format('q3', u), _INSERTED.format('p0', u))} AS p2, {least('q3', _INSERTED.format('q2', a))} AS p3 FROM ({one(table)})"
    extra = "CAST(fault = 3 AS INT)"
    own, may = "role || ':' || text || chr(10)", "fault NOT IN (1, 2)"
    delete = lambda p: _OFFER.format(p, "true", "3", "D", "''")
    keep = lambda p, i: _OFFER.format(p, f"{may} AND left(role, 1) = '{i}'", extra, "K", own)
    rerole = lambda p, r: _OFFER.format(p, may, f"2 + {extra}", "R", f"'{r}:' || text || chr(10)")
    to_user = [f(p) for p in ("p0", "p1", "p3") for f in (lambda p: keep(p, "u"), lambda p: rerole(p, "user"))]
    read = f"""SELECT conv_id, k, {delete('p0')} AS p0, {least(delete('p1'), keep('p0', 's'))} AS p1, {least(delete('p2'), *to_user)} AS p2, {least(delete('p3'), keep('p2', 'a'), rerole('p2', 'assistant'))} AS p3
  FROM (SELECT c.*, x.k, x.role, x.text, x.fault FROM ({two('search')}) c JOIN x ON x.conv_id = c.conv_id AND x.k = c.at + 1)"""
    return rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc FROM conversations
), e AS (SELECT *, xor(crc, 4294967295) % 20 AS code FROM d), r AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM e WHERE code <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM r
), x AS MATERIALIZED (
  SELECT conv_id, turn, role, text, k, CASE WHEN bare = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault, left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) || '-' || left(role, 1) AS beside FROM o
), search AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS at, {{'c': 0, 'a': '', 't': ''}} AS p0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS p1, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS p2, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS p3 FROM conversations
  UNION ALL {read}
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE beside IS NOT NULL AND beside NOT IN ('s-u', 'u-a', 'a-u')) AS illegal, max(k) AS n FROM x GROUP BY conv_id
), best AS (
  SELECT s.conv_id, {least('p0', 'p3')} AS b FROM ({two('search')}) s LEFT JOIN counts ON counts.conv_id = s.conv_id WHERE s.at = coalesce(counts.n, 0)
)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.b.c AS BIGINT) AS cost, b.b.a AS audit,
  sha256(CASE WHEN b.b.t = '' THEN '' ELSE left(b.b.t, length(b.b.t) - 1) END) AS repaired_sha256 FROM best b LEFT JOIN counts ON counts.conv_id = b.conv_id"""


ORACLE: dict[str, str] = {
    "op5_quality_rules": _LEDGER + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM b",
    "op5_rule_ablation": _LEDGER
    + """, r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('many_symbols', 4), ('repeated_lines', 8), ('word_length', 16), ('shouting', 32))
SELECT rule, count(*) FILTER (WHERE failed = bit) AS rejects_alone, count(*) FILTER (WHERE failed & bit <> 0) AS rejects, count(*) FILTER (WHERE failed <> 0) AS policy_rejects FROM b CROSS JOIN r GROUP BY rule""",
    "op7_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u
), rules(r_host, r_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fit AS (
  SELECT page_id, r_host || r_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC) AS k
  FROM h JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT h.page_id, h.host, h.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
FROM h LEFT JOIN fit ON fit.page_id = h.page_id AND fit.k = 1
""",
    "op12_conversations": _repair_sql(),
    "op13_fill_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), d AS (
  SELECT doc_id, text, w, len(w) AS n, [CAST('0x' || substr(h, 1 + 8 * k, 8) AS BIGINT) for k in range(4)] AS h FROM t
), f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(w[:least(h[1] % (n + 1), h[2] % (n + 1))], '') AS p, array_to_string(w[:greatest(h[1] % (n + 1), h[2] % (n + 1))], '') AS m FROM d
), c AS (
  SELECT doc_id, text, n, form, CASE WHEN form <> 'plain' THEN p END AS p, CASE WHEN form <> 'plain' THEN substr(m, length(p) + 1) END AS m, substr(text, length(m) + 1) AS s FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, length(p) AS prefix_chars, length(m) AS middle_chars, sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN text ELSE p || m || s END) AS restored_sha256 FROM c""",
}
