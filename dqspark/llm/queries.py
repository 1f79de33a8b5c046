"""The registered queries of the ten operators, and DuckDB SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.llm import chat, decontam, jaccard, knn, lm, rules, shard, tokenfile, tokens, urlfilter
from dqspark.llm.common import literal_rows, table
from dqspark.session import scratch

#: The rules of the url query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = knn.train(documents, table(spark, sf_dir, "labels"))
    scored = knn.score(documents, model)
    return scored.select("doc_id", knn.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), jaccard.Similarity(words=3, num=90, den=100))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = tokens.encode(table(spark, sf_dir, "documents"), path, offsets=True, decoded=True, keep=["doc_id"])
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("n_chars"),
    )


def op7_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm.score(table(spark, sf_dir, "documents"), target)


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    documents = table(spark, sf_dir, "documents")
    tokenfile.write_tokens(documents, path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.with_checksum(tokenfile.read_tokens(spark, path, documents.schema["doc_id"].dataType.simpleString()))


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: What both turns of the added conversation -1 say.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op10_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = literal_rows(spark, [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], own.columns, ["long", "long", "string", "string"])
    return chat.digests(chat.examples(own.unionByName(probe)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_quality_knn, op3_ngram_jaccard, op4_decontamination, op5_compression_rules,
        op6_byte_bpe, op7_lm_difference, op8_token_orc, op9_byte_shards, op10_prefix_targets,
    )
}

ORACLES: dict[str, str] = {
    "op1_url_filter": r"""
WITH cut AS (
  SELECT page_id, url, position('://' IN url) AS sep FROM pages
), rest AS (
  SELECT page_id, CASE WHEN sep > 0 THEN substr(url, sep + 3) ELSE '' END AS r FROM cut
), parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(host_rule, path_rule, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, host_rule || path_rule AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(host_rule || path_rule) DESC) AS k
  FROM parts JOIN rules ON (host = host_rule OR host LIKE '%.' || host_rule) AND starts_with(path, path_rule)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh
  FROM w
), t AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT u, v FROM links
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (
  SELECT u, min(v) AS m FROM reach GROUP BY u
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.m, s.doc_id)) AS component_id
FROM s LEFT JOIN least l ON l.u = s.doc_id
""",
    "op4_decontamination": r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), bw AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark
), bwin AS (
  SELECT item_id, least(10, len(ws)) AS m, unnest(list_distinct(list_transform(
    range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' ')))) AS win
  FROM bw WHERE len(ws) > 0
), sizes AS (
  SELECT DISTINCT m FROM bwin
), dwin AS (
  SELECT doc_id, m, pos, array_to_string(ws[pos:pos + m - 1], ' ') AS win
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS pos FROM dw, sizes WHERE len(ws) >= m)
), found AS (
  SELECT d.doc_id, d.pos, d.m, b.item_id FROM dwin d JOIN bwin b ON d.m = b.m AND d.win = b.win
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + m)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN named ON named.doc_id = dw.doc_id
""",
    "op10_prefix_targets": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), n AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))
            + length('<|im_start|>') + length('<|im_end|>') + 2 AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM t
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM n
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
""",
}
