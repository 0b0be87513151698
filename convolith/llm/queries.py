"""Queries of the training-data problems on text: 1, 2, 3, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolith.llm import conversations, leakage, packing, pairs, personal, spam
from convolith.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "messages").select("msg_no", "session_id", "seq", "role", "content", "tool_calls")
    return pairs.broken_pairs(messages)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.by_clock(table(spark, sf_dir, "stream_events")).select("session_id", "turn_no", "event_no")


def p2_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply graph of all whole conversations: each message's place in topological order, 0 if on or behind a cycle."""
    graph = conversations.reply_graph(conversations.conversation_rows(table(spark, sf_dir, "stream_events")))
    return graph.select("session_id", "event_no", F.coalesce("position", F.lit(0)).alias("position"), "left_over", "early")


def p2_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the order of their replies, cycles being broken ones."""
    return conversations.rebuilt(table(spark, sf_dir, "stream_events"), order="replies").select("session_id", "turn_no", "event_no")


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = table(spark, sf_dir, "messages").select(F.lit("content").alias("place"), F.col("msg_no").alias("row_no"), F.col("content").alias("text"))
    titles = table(spark, sf_dir, "sessions").select(F.lit("title").alias("place"), F.col("session_no").alias("row_no"), F.col("title").alias("text"))
    return contents.unionByName(titles)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.mentions(_personal_texts(spark, sf_dir), table(spark, sf_dir, "name_parts"))
    return found.select("place", "row_no", "pii_type", "start_at").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _personal_texts(spark, sf_dir)
    found = personal.mentions(texts, table(spark, sf_dir, "name_parts"))
    return personal.redact(texts, found)


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_kinds"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "container_kinds")
    return packing.fill_report(packing.pack(table(spark, sf_dir, "documents"), kinds), kinds)


def p7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of packing, counted where they are broken: never."""
    documents, kinds = table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_kinds")
    return packing.broken_rules(documents, packing.materialise(packing.pack(documents, kinds), "packed"), kinds)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("item_id", "doc_id").distinct()


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = leakage.materialise(leakage.find_leaks(documents, table(spark, sf_dir, "eval_items")), "leaks")
    return leakage.without_leaks(documents, leaks, spans=True)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_graph": p2_graph, "p2_replies": p2_replies, "p3_found": p3_found, "p3_redacted": p3_redacted, "p7_packed": p7_packed, "p7_fill": p7_fill, "p7_rules": p7_rules, "p8_found": p8_found, "p8_clean": p8_clean, "p9_found": p9_found}
#: White space of any kind and zero-width characters, as DuckDB's regular expressions spell them.
_NOTHING = r"[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]+"

_WHOLE = f"""keyed AS (
  SELECT event_no, type, session_id, sent_at, message.role AS role, message.content AS content,
         nullif(lower(regexp_replace(message.id, '^\\s+|\\s+$', '', 'g')), '') AS k, nullif(lower(regexp_replace(message.parent_id, '^\\s+|\\s+$', '', 'g')), '') AS p
  FROM stream_events WHERE session_id IS NOT NULL),
bounds AS (
  SELECT session_id, min(sent_at) FILTER (type = 'session_start') AS started, max(sent_at) FILTER (type = 'finalize') AS ended
  FROM keyed GROUP BY session_id),
single AS (
  SELECT *, CASE WHEN k IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY session_id, k ORDER BY event_no) END AS copy
  FROM keyed WHERE type = 'message'),
told AS (
  SELECT s.session_id, s.event_no, s.role, s.k, s.p, CAST(epoch_us(s.sent_at) AS HUGEINT) * 10000000000 + s.event_no AS key, row_number() OVER (PARTITION BY s.session_id ORDER BY s.sent_at, s.event_no) AS turn_no
  FROM single s JOIN bounds b USING (session_id)
  WHERE s.copy = 1 AND b.ended >= b.started AND s.sent_at >= b.started
    AND length(regexp_replace(coalesce(s.content, ''), '{_NOTHING}', '', 'g')) > 0),
msgs AS (
  SELECT * FROM told WHERE session_id IN (SELECT session_id FROM told WHERE role = 'user')
    AND session_id NOT IN (SELECT session_id FROM told WHERE role IS NULL OR role NOT IN ('user', 'system', 'model', 'assistant', 'thought', 'tool')))"""
#: Kahn's order with a heap, without one: by the keys that lead on the path from the root.
_GRAPH = """named AS (SELECT session_id, k, min(key) AS up FROM msgs WHERE k IS NOT NULL GROUP BY session_id, k),
linked AS (SELECT m.session_id, m.event_no, m.role, m.key, n.up FROM msgs m LEFT JOIN named n ON n.session_id = m.session_id AND n.k = m.p),
down AS (
  SELECT session_id, event_no, key, [key] AS lead FROM linked WHERE up IS NULL
  UNION ALL
  SELECT l.session_id, l.event_no, l.key, list_append(list_filter(d.lead, lambda x: x > l.key), l.key) FROM down d JOIN linked l ON l.session_id = d.session_id AND l.up = d.key),
placed AS (SELECT session_id, event_no, row_number() OVER (PARTITION BY session_id ORDER BY lead) AS position FROM down),
graph AS (SELECT l.session_id, l.event_no, l.role, p.position, p.position IS NULL AS left_over, coalesce(l.up > l.key, false) AS early FROM linked l LEFT JOIN placed p USING (session_id, event_no))"""


def _answered(rows: str, place: str) -> str:
    return f"""marks AS (
  SELECT session_id, role, lead(role) OVER (PARTITION BY session_id ORDER BY {place}) AS next_role FROM {rows} WHERE role IN ('user', 'model', 'assistant')),
bad AS (SELECT session_id FROM marks WHERE role = 'user' AND (next_role IS NULL OR next_role = 'user'))"""


ORACLE = {
    "p7_rules": "SELECT container_name, CAST(0 AS BIGINT) AS over_full, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS uncovered, (SELECT count(*) FROM documents WHERE text <> '') AS texts FROM container_kinds",
    "p2_found": f"""WITH {_WHOLE}, {_answered('msgs', 'turn_no')}
SELECT session_id, CAST(turn_no AS BIGINT) AS turn_no, event_no FROM msgs WHERE session_id NOT IN (SELECT session_id FROM bad)""",
    "p2_graph": f"""WITH RECURSIVE {_WHOLE}, {_GRAPH}
SELECT session_id, event_no, CAST(coalesce(position, 0) AS BIGINT) AS position, left_over, early FROM graph""",
    "p2_replies": f"""WITH RECURSIVE {_WHOLE}, {_GRAPH}, {_answered('graph', 'position')}
SELECT session_id, CAST(position AS BIGINT) AS turn_no, event_no FROM graph
WHERE session_id NOT IN (SELECT session_id FROM bad) AND session_id NOT IN (SELECT session_id FROM graph WHERE left_over)""",
}
