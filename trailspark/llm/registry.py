"""The driver's thin queries over the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, filter_audit, html_text, media, ngram_join, packing, pii, prefix_trie, quality, suffix_dedup, token_counts, toxicity
from .common import table

TOKEN_LIMIT = 512


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verified leaks: document, item, score and overlaps."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "question_overlap", "answer_overlap")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store(table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


#: The text of both turns of conversation -1.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.format_turns(conversations))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_join, op2_decontamination, op3_pii, op4_packing, op5_substring_dedup, op6_media, op7_token_counts, op8_quality, op9_toxicity, op10_html_text, op11_chat_format, op12_filter_audit, op13_prefix_trie)
}
#: The others have no form in SQL; tests hold them to brute force, round trips or held-out rows.
SQL: dict[str, str] = {
    "op1_ngram_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM meets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS d, a AS c FROM both_ways UNION SELECT reach.d, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.c)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.c, w.doc_id) AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT d, min(c) AS c FROM reach GROUP BY 1) r ON r.d = w.doc_id
""",
    "op11_chat_format": r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
-- a reference is as long as its placeholder: <|image|>, <|audio|>, <|document|>
parts AS (
  SELECT *, role <> 'assistant' AS parsed, regexp_extract_all(text, '!\[[^\]\n]*\]\([^()\s]+\.(?:png|jpg|jpeg|gif|webp|bmp|svg|mp3|wav|ogg|flac|m4a|pdf|doc|docx|txt|md|html)\)') AS refs FROM every),
sizes AS (
  SELECT *, length('<|im_start|>') + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + 1 + length('<|im_end|>') + 1
    + CASE WHEN NOT parsed OR len(refs) = 0 THEN length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
      ELSE length(regexp_replace(regexp_replace(text, '!\[[^\]\n]*\]\([^()\s]+\.(?:png|jpg|jpeg|gif|webp|bmp|svg|mp3|wav|ogg|flac|m4a|pdf|doc|docx|txt|md|html)\)', ' ', 'g'), '<(\\*)\|', '<\\\1|', 'g'))
        + list_sum(list_transform(refs, lambda x: CASE WHEN regexp_matches(x, '\.(mp3|wav|ogg|flac|m4a|png|jpg|jpeg|gif|webp|bmp|svg)\)$') THEN 8 ELSE 11 END)) END AS n
  FROM parts)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, coalesce(sum(CASE WHEN parsed THEN len(refs) ELSE 0 END), 0)::BIGINT AS n_attachments, coalesce(sum(CASE WHEN parsed THEN len(refs) ELSE 0 END), 0)::BIGINT AS n_expanded
FROM sizes GROUP BY conv_id
""",
    "op12_filter_audit": r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
fails AS (
  SELECT part, doc_id, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM cut),
tally AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM fails LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
letters AS (SELECT unnest(range(5)) AS f),
perms AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT list_reduce(list_transform(o, lambda x: chr((65 + x)::INT)), lambda x, y: x || y) AS filter_order, s::INT AS step, 1 << o[s]::INT AS bit, list_sum(list_transform(o[:s - 1], lambda x: (1 << x::INT)))::INT AS before
  FROM perms, (SELECT unnest(range(1, 6)) AS s)),
found AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & coalesce(before, 0) <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM tally, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM found
""",
    "op13_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, sha256(length(role) || ':' || role || text) AS digest, length(text) AS chars FROM turns),
rows_ AS (
  SELECT conv_id, 0 AS depth, '' AS prefix, NULL AS up, 0 AS chars FROM convs
  UNION ALL SELECT conv_id, depth, string_agg(digest, '') OVER w, coalesce(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), chars FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
lengths AS (SELECT conv_id, max(depth) AS len FROM rows_ GROUP BY 1),
nodes AS (
  SELECT prefix, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = depth), '') AS ids
  FROM rows_ JOIN lengths USING (conv_id) GROUP BY prefix),
kids AS (SELECT up AS prefix, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY 1),
-- the owner of a node below has every prefix of it among its rows
below AS (
  SELECT r.prefix, sum(CASE WHEN k.prefix IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((d.n - 1) * d.chars) AS saved_tokens
  FROM nodes d JOIN rows_ r ON r.conv_id = d.conv_id AND r.depth <= d.depth LEFT JOIN kids k ON k.prefix = d.prefix GROUP BY 1)
SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(x.ids) AS ends_sha256
FROM nodes x JOIN below b USING (prefix) LEFT JOIN kids k USING (prefix) LEFT JOIN nodes p ON p.prefix = x.up
""",
}
