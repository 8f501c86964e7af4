"""The thin queries opN_<name> over the shared tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tickforge.llm import alignment, chat, editembed, html, mixing, ngrams, packing, prefixtrie, quality, simhash, tokencount, topk, urlrules
from tickforge.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.read_back(chat.formatted(rows.unionByName(chat.hostile(spark)))))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urlrules.RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.train_and_score(table(spark, sf_dir, "documents"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op11_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editembed.fingerprints(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_html_extraction,
        op2_quality_rules,
        op3_simhash_dedup,
        op4_chat_formatting,
        op5_packing,
        op6_url_filters,
        op7_source_mixing,
        op8_lm_scoring,
        op9_topk_search,
        op10_token_counts,
        op11_edit_fingerprints,
        op12_prefix_trie,
        op13_tokenizer_alignment,
        pipeline,
    )
    return {f.__name__: f for f in every}


def _chat_sql() -> str:
    control = chat.control_pattern().replace("'", "''")
    sizes = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in chat.MARKS.items())
    other = len(chat.OTHER) + len(chat.ROLE_END) + len(chat.OTHER_END)
    marks = chat._any(chat.CONTROL).replace("'", "''")
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, {sizes} ELSE {other} + length(role) + len(regexp_extract_all(role, '[\\[<\\\\]')) END AS marks,
    regexp_matches(text, '{control}') AS conflict,
    length(text) AS plain,
    length(text) + len(regexp_extract_all(text, '\\\\')) + len(regexp_extract_all(text, '{marks}')) AS careful
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(marks) + CASE WHEN bool_or(conflict) THEN sum(careful) ELSE sum(plain) END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""


def _url_sql() -> str:
    named = sorted(urlrules.NAMED, key=lambda r: (-len(r.name), r.name))
    text = lambda x: "'" + x.replace("'", "''") + "'"
    fit = lambda r: f"regexp_matches(subject, {text(r.pattern.replace(chr(92) + 'A', '^'))})"
    rule = " ".join(f"WHEN {fit(r)} THEN {text(r.name)}" for r in named)
    verdict = " ".join(f"WHEN {fit(r)} THEN {text(r.verdict)}" for r in named)
    words = " OR ".join(f"regexp_matches(subject, {text(r.pattern.replace(chr(92) + 'A', '^').replace(chr(92) + 'z', '$'))})" for r in urlrules.WORDS)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{urlrules.UPPER}', '{urlrules.LOWER}') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
s AS (SELECT *, host || path AS subject FROM hp)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN {words} THEN 'block' ELSE '{urlrules.DEFAULT}' END AS verdict
FROM s"""


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    greatest(0.1::DOUBLE, 1 - coalesce((length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / greatest(length(text), 1), 0)) AS weight,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS total, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT source, total, [3.0, 1.0, 2.0][((k - 1) % 3 + 1)::INT]::DOUBLE AS w, 2 * total AS most FROM s),
r AS (
  SELECT *, most / w AS ratio,
    (1.5 * sum(total) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, total, CASE WHEN ratio <= level THEN most ELSE w * (SELECT arg_min(level, ratio) FROM r WHERE ratio > level) END AS target FROM r),
e AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.doc_id, d.size, e.total, e.target, e.epochs, e.target - e.epochs * e.total AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.weight, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, total::BIGINT AS source_size, target,
  (size * (epochs + CASE WHEN before + size / 2.0 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p"""

TOPK_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row AS query, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""


# crc32 by bits: each byte joins the register, which is shifted eight times
TRIE_SQL = """
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) - 1 AS pos
  FROM (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS name,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, t.pos, t.name, t.words FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), t.name, t.words
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h LEFT JOIN c b ON b.conv_id = c.base),
p AS (
  SELECT conv_id, pos + 1 AS depth, words, string_agg(name, ',') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN depth > 0 THEN (count(*) - 1) * min(words) ELSE 0 END AS value
  FROM p GROUP BY depth, key),
u AS (SELECT n.*, p.key AS up FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
k AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.key = n.key),
s AS (
  SELECT p.depth, p.key, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.value) AS saved
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.depth, p.key),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT depth, key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM p JOIN l USING (conv_id, depth) GROUP BY depth, key)
SELECT u.conv_id, u.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, u.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM u JOIN f ON f.depth = u.depth AND f.key = u.key JOIN s ON s.depth = u.depth AND s.key = u.key
LEFT JOIN n m ON m.depth = u.depth - 1 AND m.key = u.up LEFT JOIN e ON e.depth = u.depth AND e.key = u.key"""


def oracle_sql() -> dict[str, str]:
    found = {
        "op4_chat_formatting": _chat_sql(),
        "op6_url_filters": _url_sql(),
        "op7_source_mixing": MIX_SQL,
        "op9_topk_search": TOPK_SQL,
        "op12_prefix_trie": TRIE_SQL,
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
