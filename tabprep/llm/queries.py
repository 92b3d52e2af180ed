"""One query for each operator, over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.llm import decontaminate, html, hpylm, licenses, negatives, packing, pieces, quality, simhash, substrings, tokens, trie, urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# Hosts of these words are listed: their pages' URLs are the list of operator 6 (fixed values).
LISTED_HOSTS = r"(^|[.-])(casino|pills|spam|adult|bets|ads)([.-]|$)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.histogram(tokens.lengths(table(spark, sf_dir, "documents")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hpylm.score(table(spark, sf_dir, "documents"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(urls.host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    return urls.judge(pages, listed, RULES).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), paths=True)
    digest = F.sha2(F.array_join("ids", ",").cast("binary"), 256)
    back = pieces.decode(encoded.select("id", "ids", "n_pieces", "scores", "text_sha256", digest.alias("ids_sha256"), F.xxhash64("paths").alias("paths_hash")))
    exact = F.sha2(F.col("text").cast("binary"), 256).eqNullSafe(F.col("text_sha256"))
    return back.select(F.col("id").alias("doc_id"), "n_pieces", F.element_at("scores", 1).alias("score"), F.size("scores").alias("n_paths"),
                       F.try_element_at("scores", F.lit(2)).alias("second_score"), "scores", "ids_sha256", exact.alias("exact"), "paths_hash")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine(rows, F.col("id") % 100 == 0)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"))
    digests = cut.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.build(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_rules, op2_token_counts, op3_simhash, op4_lm_scoring, op5_html_extraction, op6_url_filter,
    op7_license_scan, op8_decontamination, op9_substring_dedup, op10_piece_encoding, op11_hard_negatives, op12_packing, op13_prefix_trie)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE: dict[str, str] = {
    "op6_url_filter": r"""
WITH p AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         list_sort(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), ''), '&'),
                               lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS asked
  FROM pages),
c AS (
  SELECT *, CASE WHEN host <> '' THEN
           regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)?$', '')
           || regexp_replace(regexp_replace(path, '/+$', ''), '\.html?$', '')
           || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical
  FROM p),
listed AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND regexp_matches(host, '(^|[.-])(casino|pills|spam|adult|bets|ads)([.-]|$)')),
r(says, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (
  SELECT page_id, host, path, canonical,
         (SELECT max_by(h || r.p, length(h || r.p)) FROM r WHERE (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, r.p)) AS rule
  FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN (SELECT says FROM r WHERE h || r.p = rule)
            WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM f
""",
    "op8_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
w AS (
  SELECT DISTINCT item_id, CASE WHEN len(words) < 13 THEN words ELSE words[i:i+12] END AS win, least(len(words), 13) AS n
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
g AS (
  SELECT doc_id, i, words[i:i+n-1] AS win, n
  FROM (SELECT doc_id, words, s.n, unnest(range(1, len(words) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) s WHERE len(words) >= s.n)),
h AS (SELECT DISTINCT g.doc_id, g.i, g.n, w.item_id FROM g JOIN w ON g.win = w.win AND g.n = w.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i+49], ' ')) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50)),
f AS (SELECT win, min(doc_id) AS owner FROM g GROUP BY win),
gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f USING (win) WHERE owner < doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, words, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN words
              ELSE list_transform(list_sort(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(places, i))), lambda i: words[i]) END AS left_over
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, n_removed, sha256(array_to_string(left_over, ' ')) AS kept_sha256 FROM kept
""",
    "op11_hard_negatives": r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""",
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'r': r, 'x': x} ORDER BY i) AS own,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
             lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 4 AS h
  FROM t GROUP BY conv_id),
b AS (
  SELECT c.conv_id, list_concat(coalesce(base.own[1:c.h], []), c.own[c.h + 1:]) AS turns
  FROM c LEFT JOIN c AS base ON base.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, turns, d, turns[1:d] AS node FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM b)),
n AS (
  SELECT d AS depth, node, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = d), '')) AS ends_sha256
  FROM m GROUP BY d, node),
k AS (SELECT depth - 1 AS depth, node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(string_split_regex(node[depth].x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS saved
  FROM n LEFT JOIN k USING (depth, node)),
s AS (
  SELECT up AS depth, node[1:up] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM f) GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (depth, node) LEFT JOIN f AS p ON p.depth = f.depth - 1 AND p.node = f.node[1:f.depth - 1]
""",
}
