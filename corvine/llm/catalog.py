"""Registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import defects, leakage, packing, provenance, spans, stuffing, threads, vectors
from corvine.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, root, "chunks"))


def p1_neighbours(spark: SparkSession, root: str) -> DataFrame:
    near = vectors.nearest_vectors(table(spark, root, "chunks"), min_similarity=None, relax=1.0)
    return near.withColumn("similarity", F.round("similarity", 5))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    seen = threads.verdicts(table(spark, root, "conversations"), table(spark, root, "messages"))
    return seen.filter(~F.col("keep")).select("conversation_id")


def p2_conversations(spark: SparkSession, root: str) -> DataFrame:
    return threads.rebuilt(table(spark, root, "conversations"), table(spark, root, "messages"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return provenance.not_hand_written(table(spark, root, "files"), table(spark, root, "chunks"))


def p3_kinds(spark: SparkSession, root: str) -> DataFrame:
    return provenance.classified(table(spark, root, "files"), table(spark, root, "chunks"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return spans.SharedSpans(table(spark, root, "chunks")).pairs()


def p4_coverage(spark: SparkSession, root: str) -> DataFrame:
    return spans.SharedSpans(table(spark, root, "chunks")).coverage()


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return defects.one_label(table(spark, root, "messages"))


def p5_labels(spark: SparkSession, root: str) -> DataFrame:
    return defects.labels(table(spark, root, "messages")).withColumn("posterior", F.round("posterior", 4))


def p6_packed(spark: SparkSession, root: str) -> DataFrame:
    return packing.packed(table(spark, root, "documents"))


def p6_texts(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, times, first_token, gaps): each text comes out once, from its first token on and without gaps."""
    rows = packing.packed(table(spark, root, "documents"))
    ends = F.array_sort(F.collect_list(F.struct("piece", "first_token", "n_tokens")))
    by = rows.groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("times"), F.min("first_token").alias("first_token"), ends.alias("x"))
    gaps = F.size(F.filter("x", lambda x, i: (i > 0) & (x["first_token"] != F.element_at("x", F.greatest(i, F.lit(1)))["first_token"] + F.element_at("x", F.greatest(i, F.lit(1)))["n_tokens"])))
    return by.select("doc_id", "times", "first_token", gaps.cast("long").alias("gaps"))


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill(table(spark, root, "documents"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, root, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_neighbours, p2_found, p2_conversations, p3_found, p3_kinds, p4_found, p4_coverage,
        p5_found, p5_labels, p6_packed, p6_texts, p6_fill, p7_found, p7_passages, p8_found,
    )
}

#: The rule of p2, the wholeness of p6 and the word runs of p7 are plain SQL; the other operators are tested by brute force.
SQL = {
    "p2_found": r"""
WITH m AS (
  SELECT DISTINCT ON (id) id, conversation_id, lower(regexp_replace(role, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS role, content, created_at
  FROM messages WHERE id IS NOT NULL AND conversation_id IS NOT NULL),
t AS (
  SELECT *, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS side FROM m
  WHERE created_at IS NOT NULL AND regexp_matches(coalesce(content, ''), '[^\s\p{Z}\p{C}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{2800}\x{3164}\x{FE0E}\x{FE0F}\x{FFA0}]')),
o AS (
  SELECT *, lag(role) OVER w AS prev_role, lag(content) OVER w AS prev_content FROM t
  WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, side, id)),
k AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, side, id) AS n FROM o
  WHERE NOT coalesce(prev_role = role AND prev_content = content, false)),
good AS (
  SELECT conversation_id FROM k GROUP BY conversation_id
  HAVING count(*) >= 2 AND count(*) % 2 = 0 AND bool_and(role = CASE WHEN n % 2 = 1 THEN 'user' ELSE 'assistant' END)),
bad AS (SELECT DISTINCT conversation_id FROM m WHERE created_at IS NULL OR NOT coalesce(role IN ('user', 'assistant'), false)),
ids AS (SELECT id AS conversation_id FROM conversations WHERE id IS NOT NULL UNION SELECT conversation_id FROM m)
SELECT conversation_id FROM ids
WHERE conversation_id NOT IN (SELECT conversation_id FROM good)
   OR conversation_id IN (SELECT conversation_id FROM bad)
   OR conversation_id NOT IN (SELECT id FROM conversations WHERE id IS NOT NULL)
""",
    "p6_texts": """
SELECT doc_id, CAST(1 AS BIGINT) AS times, CAST(0 AS BIGINT) AS first_token, CAST(0 AS BIGINT) AS gaps
FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id
""",
    "p7_found": r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS words
  FROM (SELECT item_id, question AS t FROM eval_items UNION ALL SELECT item_id, answer FROM eval_items)),
g AS (SELECT DISTINCT item_id, array_to_string(words[i:i + 11], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, len(words) - 10)) AS i FROM w WHERE len(words) >= 12)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, array_to_string(words[i:i + 11], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 10)) AS i FROM d WHERE len(words) >= 12))
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (gram)
""",
}
