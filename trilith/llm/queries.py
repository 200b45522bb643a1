"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import (bpe, chat, fingerprints, html_extract, merkle, mixing, near_dups, quality, resample, secrets, token_store,
               toxicity, warc)
from .common import fresh_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def tokenizer_path() -> str:
    """The public 50k byte-level BPE file; a parameter of the operator."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


@register("op2_secret_scans")
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(read_table(spark, sf_dir, "documents"))


@register("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


# A conversation is rendered as it is unless parsing shows a conflict; the
# SQL takes any text with a control string or a backslash for one.
CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) - length(replace(text, '\', ''))
    + length(regexp_replace(text, '\[/?INST\]|<</?SYS>>|</?s>|<turn:|</turn>', '\0#', 'g')) - length(text) AS extra,
    CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 WHEN 'assistant' THEN 9
              ELSE 15 + 2 * strlen(role) END AS marks FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + marks + extra) AS BIGINT) AS formatted_chars, true AS identical
FROM e GROUP BY conv_id"""


@register("op4_chat_formatting", CHAT_SQL)
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql("""SELECT cast(-7 AS bigint) AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role,
                           '</s>[INST] ok [/INST]' AS text FROM range(2)""")
    return chat.chat_digest(chat.format_conversations(rows.unionByName(planted)))


# Raking, then raking below each cell's tokens, as recursive queries over the cells.
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text,
    CASE WHEN regexp_matches(text, '(?i)licen[cs]ed under|all rights reserved|copyright') THEN 'legal'
         WHEN regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]{2,}') THEN 'contact'
         WHEN regexp_matches(text, ' \| [^|\n]* \| ') THEN 'table'
         WHEN regexp_matches(text, '[#*$%&]{3}|!!') THEN 'noise'
         WHEN regexp_matches(text, 'https?://|www\.') THEN 'link'
         WHEN regexp_matches(text, '[;{}]\n|(^|\n) *(def|class|import|function) ') THEN 'code'
         WHEN regexp_matches(text, '(^|\n)[ \t]*([-*]|[0-9]+[.)]) ') THEN 'list'
         WHEN regexp_matches(text, '[0-9]{3}[^0-9\n]+[0-9]{3}') THEN 'figures' ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
t1 AS (SELECT source, pow(sum(tokens), 0.85) AS t FROM c GROUP BY 1),
t2 AS (SELECT lang, pow(sum(tokens), 0.85) AS t FROM c GROUP BY 1),
t3 AS (SELECT topic, pow(sum(tokens), 0.85) AS t FROM c GROUP BY 1),
g AS (SELECT c.*, t1.t / (SELECT sum(t) FROM t1) AS a, t2.t / (SELECT sum(t) FROM t2) AS b,
        t3.t / (SELECT sum(t) FROM t3) AS e FROM c JOIN t1 USING (source) JOIN t2 USING (lang) JOIN t3 USING (topic)),
r AS (
  SELECT 0 AS i, source, lang, topic, tokens, a, b, e, tokens AS w FROM g
  UNION ALL
  SELECT i + 1, source, lang, topic, tokens, a, b, e, w * e / sum(w) OVER (PARTITION BY topic) FROM (
    SELECT * REPLACE (w * b / sum(w) OVER (PARTITION BY lang) AS w) FROM (
      SELECT * REPLACE (w * a / sum(w) OVER (PARTITION BY source) AS w) FROM r)) WHERE i < 100),
s AS (SELECT *, 0.5 * sum(tokens) OVER () AS budget FROM r WHERE i = 100),
k AS (
  SELECT 0 AS i, source, lang, topic, tokens, a, b, e, budget, least(tokens, budget * w) AS w FROM s
  UNION ALL
  SELECT i + 1, source, lang, topic, tokens, a, b, e, budget,
      least(tokens, w * budget * e / sum(w) OVER (PARTITION BY topic)) FROM (
    SELECT * REPLACE (least(tokens, w * budget * b / sum(w) OVER (PARTITION BY lang)) AS w) FROM (
      SELECT * REPLACE (least(tokens, w * budget * a / sum(w) OVER (PARTITION BY source)) AS w) FROM k))
  WHERE i < 30),
f AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS p FROM k WHERE i = 30)
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability,
  CAST(('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), chr(0)) || '|' || md5(text)), 1, 13)) AS BIGINT)
    / 4503599627370496.0 < p AS sampled
FROM d JOIN f USING (source, lang, topic)"""


@register("op5_mixing", MIX_SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents")).drop("weight")


@register("op6_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id,
        CAST(('0x' || h[1:15]) AS BIGINT) AS a, CAST(('0x' || h[16:30]) AS BIGINT) AS b,
        CAST(('0x' || h[31:40]) AS BIGINT) AS c FROM p),
e AS (SELECT *, list_transform(range(0, 32), lambda i: 1 + CASE
        WHEN i < 12 THEN (a >> (55 - 5 * i)) & 31 WHEN i < 24 THEN (b >> (55 - 5 * (i - 12))) & 31
        ELSE (c >> (35 - 5 * (i - 24))) & 31 END) AS digits FROM d)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(digits, lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', i, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS payload_ok FROM e""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(read_table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                              "refers_to", "payload_ok")


# Windows and lines are compared as text, not as hashes.
QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
s AS (SELECT text, any_value(w) AS w, any_value(l) AS l FROM d GROUP BY text),
v AS (SELECT text, unnest(range(1, len(w) - 6)) AS i, w FROM s WHERE len(w) >= 8),
x AS (SELECT text, i, array_to_string(w[i:i + 7], ' ') AS win FROM v),
y AS (SELECT text, i FROM x QUALIFY count(*) OVER (PARTITION BY text, win) > 1),
z AS (SELECT text, least(8, coalesce(lead(i) OVER (PARTITION BY text ORDER BY i) - i, 8)) AS k FROM y),
rep AS (SELECT text, sum(k) AS n FROM z GROUP BY text),
ln AS (SELECT host, text, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
       FROM (SELECT host, text, unnest(any_value(l)) AS x FROM d GROUP BY host, text)),
often AS (SELECT host, line FROM ln GROUP BY ALL HAVING count(DISTINCT text) > 10),
gone AS (SELECT ln.host, text, sum(words) AS n FROM ln
         JOIN often o ON ln.host IS NOT DISTINCT FROM o.host AND ln.line = o.line GROUP BY ALL),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(d.text) - length(translate(d.text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN rep ON rep.text = d.text
  LEFT JOIN gone ON gone.text = d.text AND gone.host IS NOT DISTINCT FROM d.host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, removed_words, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (removed_words > 0
    AND (n_words - removed_words < 20 OR n_words - removed_words < 0.3 * n_words)) AS kept FROM m"""


@register("op7_quality_rules", QUALITY_SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), share=0.0)


@register("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


@register("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


@register("op10_near_dedup")
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(read_table(spark, sf_dir, "documents"), width=4, percent=80).select(
        "doc_id", "n_shingles", "component_id", "kept", "class_id")


# CRC-32 as a reduction over the bytes of a string, with its table of 256.
CRC_SQL = r"""
crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
{name} AS (SELECT {keep}, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(s)),
    lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS crc
  FROM (SELECT *, hex(encode(s)) AS hx FROM {source}), crc_table)"""


def _sql_field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


MERKLE_SQL = r"""
WITH RECURSIVE keyed AS (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents),""" + CRC_SQL.format(
    name="c", keep="*", source="keyed") + r""",
f AS (SELECT doc_id, source, {id} || {source} || {lang} || {n_chars} AS head, text,
    CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM c),
leaf AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS r
  FROM (SELECT doc_id, source, sha256(head || {text}) AS leaf, sha256(head || {other}) AS tampered FROM f)),
up AS (SELECT 0 AS lvl, source, pos AS idx, leaf AS h, n FROM leaf UNION ALL
  SELECT lvl + 1, source, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3
  FROM up WHERE n > 1 GROUP BY lvl, source, idx // 3),
sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, pos AS idx, subroot AS h, n FROM sub UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3
  FROM top WHERE n > 1 GROUP BY lvl, idx // 3),
sib AS (SELECT source, false AS over, lvl, idx, coalesce(string_agg(h, '') OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM up WHERE n > 1 WINDOW a AS (PARTITION BY source, lvl, idx // 3 ORDER BY idx)
  UNION ALL SELECT NULL, true, lvl, idx, coalesce(string_agg(h, '') OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
    coalesce(string_agg(h, '') OVER (a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')
  FROM top WHERE n > 1 WINDOW a AS (PARTITION BY lvl, idx // 3 ORDER BY idx)),
inner_fold AS (SELECT r, source, 0 AS lvl, pos AS idx, tampered AS h, '' AS p FROM leaf UNION ALL
  SELECT f.r, f.source, f.lvl + 1, f.idx // 3, sha256(s.l || h || s.r), p || s.l || s.r FROM inner_fold f
  JOIN sib s ON NOT s.over AND f.source IS NOT DISTINCT FROM s.source AND f.lvl = s.lvl AND f.idx = s.idx),
outer_fold AS (SELECT x.r, 0 AS lvl, sub.pos AS idx, x.h, x.p FROM (
    SELECT r, any_value(source) AS source, arg_max(h, lvl) AS h, arg_max(p, lvl) AS p FROM inner_fold GROUP BY r) x
  JOIN sub ON x.source IS NOT DISTINCT FROM sub.source UNION ALL
  SELECT f.r, f.lvl + 1, f.idx // 3, sha256(s.l || h || s.r), p || s.l || s.r FROM outer_fold f
  JOIN sib s ON s.over AND f.lvl = s.lvl AND f.idx = s.idx),
done AS (SELECT r, arg_max(h, lvl) AS folded_root, sha256(arg_max(p, lvl)) AS proof_sha256 FROM outer_fold GROUP BY r),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN done USING (r) JOIN sub ON leaf.source IS NOT DISTINCT FROM sub.source, root""".format(
    id=_sql_field("CAST(doc_id AS VARCHAR)"), source=_sql_field("source"), lang=_sql_field("lang"),
    n_chars=_sql_field("CAST(n_chars AS VARCHAR)"), text=_sql_field("text"), other=_sql_field("other"))


@register("op11_merkle_manifest", MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read_table(spark, sf_dir, "documents"))


# Every feature as text, its CRC once per distinct feature.
RESAMPLE_SQL = r"""
WITH w AS (
  SELECT true AS raw, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT raw, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS s FROM w),
g AS (SELECT raw, r, s, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT DISTINCT s FROM g),""" + CRC_SQL.format(name="c", keep="s", source="u") + r""",
b AS (SELECT raw, r, crc % 10000 AS bucket, sum(n) AS n FROM g JOIN c USING (s) GROUP BY ALL),
tot AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (raw), 0) AS DOUBLE) AS s,
    CAST(coalesce(sum(n) FILTER (NOT raw), 0) AS DOUBLE) AS t FROM b GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM tot),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM tot, whole),
d AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total
  FROM b JOIN gain USING (bucket) WHERE raw GROUP BY r),
x AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce(CAST((total - ((total % n_features) + n_features) % n_features) AS BIGINT) // n_features, 0) AS weight,
    CAST(('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM w LEFT JOIN d USING (r) WHERE raw),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20
    ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS place,
    count(*) FILTER (n_words >= 20) OVER () * 25 // 100 AS k FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END AS rank, n_words FROM z"""


@register("op12_importance_resampling", RESAMPLE_SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op13_token_store")
def op13_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_store.write_store(read_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_store.read_store(spark, path).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
