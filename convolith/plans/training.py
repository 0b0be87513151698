"""Queries of the training-data problems that are general: 4 hierarchies, 5 schema drift, 6 copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolith.operators import delivery, hierarchy, schema_drift
from convolith.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "messages").select("session_id", "id", "parent_id")
    return hierarchy.hierarchies(messages, "session_id", "id", "parent_id").select("session_id", "id", "root_id", "depth", "n_below")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "messages").select("session_id", "id", "parent_id")
    full = hierarchy.hierarchies(messages, "session_id", "id", "parent_id", with_path=True)
    return full.select("session_id", "id", F.array_join("path", "/").alias("path"))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "messages").select("session_id", "id", "parent_id")
    return hierarchy.descendants(messages, "session_id", "id", "parent_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, sf_dir, "session_inputs"))


def p5_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which keys come and go at each boundary, by the list of changes: a renamed one goes and comes."""
    changes = schema_drift.materialise(schema_drift.schema_changes(table(spark, sf_dir, "session_inputs")), "changes")
    gone = changes.where("change_type in ('removed', 'renamed')").select("feed", "file_no", F.col("field_name").alias("key"), F.lit("gone").alias("what"))
    came = changes.where("change_type in ('added', 'renamed')").select("feed", "file_no", F.when(F.col("change_type") == "renamed", F.col("to_name")).otherwise(F.col("field_name")).alias("key"), F.lit("came").alias("what"))
    return gone.unionByName(came)


def p5_retyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, sf_dir, "session_inputs")).where("change_type = 'retyped'").select("feed", "file_no", "field_name", "to_name")


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = table(spark, sf_dir, "session_inputs")
    changes = schema_drift.materialise(schema_drift.schema_changes(inputs), "changes")
    sessions = table(spark, sf_dir, "sessions").withColumns({"feed": F.lit(None).cast("string"), "file_no": F.lit(None).cast("int")})
    outcome = schema_drift.exploded(sessions, "feed", "file_no", "session_no", "id", "metadata_json")
    files = schema_drift.materialise(schema_drift.unified_table(inputs, changes), "files")
    out = schema_drift.consistent_table(files, outcome, changes)
    at = lambda origin: F.when(F.col("origin") == origin, F.col("row_no"))
    return out.select(at("files").alias("input_no"), at("outcome").alias("session_no"), "feed", "file_no", "field", "kind", "value", "key", "raw_kind", "raw", "failed")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "stream_events").where("type = 'message'")
    return delivery.surplus_copies(events, F.col("session_id"), F.col("message.id"), "event_no", F.col("batch_no"))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message rows that stay: one of each identifier, and all that identify nothing."""
    events = table(spark, sf_dir, "stream_events").where("type = 'message'")
    return delivery.drop_copies(events, F.col("session_id"), F.col("message.id"), "event_no", F.col("batch_no")).select("event_no", "session_id", F.col("message.role").alias("role"), F.col("message.content").alias("content"))


QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p5_found": p5_found, "p5_presence": p5_presence, "p5_retyped": p5_retyped, "p5_unified": p5_unified, "p6_found": p6_found, "p6_kept": p6_kept}

_TREE = """
nodes AS (SELECT session_id, id, min(parent_id) AS parent_id FROM messages WHERE id IS NOT NULL GROUP BY session_id, id),
linked AS (SELECT n.session_id, n.id, p.id AS up FROM nodes n LEFT JOIN nodes p ON p.session_id IS NOT DISTINCT FROM n.session_id AND p.id = n.parent_id),
down AS (
  SELECT session_id, id, id AS root_id, 0 AS depth, [id] AS path FROM linked WHERE up IS NULL
  UNION ALL
  SELECT l.session_id, l.id, d.root_id, d.depth + 1, list_append(d.path, l.id) FROM down d JOIN linked l ON l.session_id IS NOT DISTINCT FROM d.session_id AND l.up = d.id
)"""

_KEYS = """k AS (SELECT feed, file_no, input_no, unnest(json_keys(metadata)) AS key, metadata FROM session_inputs WHERE feed IS NOT NULL AND file_no IS NOT NULL AND json_valid(metadata)),
t AS (SELECT feed, file_no, key, CASE json_type(metadata, '$."' || key || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'decimal' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END AS kind FROM k),
present AS (SELECT feed, file_no, key, arg_max(kind, n) FILTER (kind IS NOT NULL) AS kind FROM (SELECT feed, file_no, key, kind, count(*) AS n FROM t GROUP BY ALL) GROUP BY ALL),
steps AS (SELECT * FROM (SELECT feed, file_no, lag(file_no) OVER (PARTITION BY feed ORDER BY file_no) AS prev_no FROM (SELECT DISTINCT feed, file_no FROM session_inputs WHERE feed IS NOT NULL AND file_no IS NOT NULL)) WHERE prev_no IS NOT NULL)"""

ORACLE = {
    "p4_found": f"""WITH RECURSIVE {_TREE},
below AS (SELECT session_id, a AS id, count(*) AS n FROM (SELECT session_id, id, unnest(path) AS a FROM down) WHERE a <> id GROUP BY session_id, a)
SELECT n.session_id, n.id, coalesce(d.root_id, 'cycle') AS root_id, CAST(coalesce(d.depth, -1) AS BIGINT) AS depth,
       CAST(CASE WHEN d.id IS NULL THEN -1 ELSE coalesce(b.n, 0) END AS BIGINT) AS n_below
FROM nodes n LEFT JOIN down d ON d.session_id IS NOT DISTINCT FROM n.session_id AND d.id = n.id
LEFT JOIN below b ON b.session_id IS NOT DISTINCT FROM n.session_id AND b.id = n.id""",
    "p4_paths": f"""WITH RECURSIVE {_TREE}
SELECT n.session_id, n.id, array_to_string(d.path, '/') AS path
FROM nodes n LEFT JOIN down d ON d.session_id IS NOT DISTINCT FROM n.session_id AND d.id = n.id""",
    "p5_presence": f"""WITH {_KEYS}
SELECT s.feed, s.file_no, o.key, 'gone' AS what FROM steps s JOIN present o ON o.feed = s.feed AND o.file_no = s.prev_no ANTI JOIN present n ON n.feed = s.feed AND n.file_no = s.file_no AND n.key = o.key
UNION ALL SELECT s.feed, s.file_no, n.key, 'came' FROM steps s JOIN present n ON n.feed = s.feed AND n.file_no = s.file_no ANTI JOIN present o ON o.feed = s.feed AND o.file_no = s.prev_no AND o.key = n.key""",
    "p5_retyped": f"""WITH {_KEYS}
SELECT s.feed, s.file_no, n.key AS field_name, n.kind AS to_name FROM steps s JOIN present o ON o.feed = s.feed AND o.file_no = s.prev_no JOIN present n ON n.feed = s.feed AND n.file_no = s.file_no AND n.key = o.key WHERE o.kind <> n.kind""",
    "p6_found": """WITH e AS (
  SELECT event_no, session_id, lower(regexp_replace(message.id, '^\\s+|\\s+$', '', 'g')) AS k FROM stream_events WHERE type = 'message'),
g AS (SELECT session_id, k, min(event_no) AS kept_no FROM e WHERE k <> '' GROUP BY session_id, k)
SELECT g.kept_no, e.event_no AS surplus_no FROM e JOIN g USING (session_id, k) WHERE e.event_no <> g.kept_no""",
    "p6_kept": """SELECT event_no, session_id, message.role AS role, message.content AS content FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, lower(regexp_replace(message.id, '^\\s+|\\s+$', '', 'g')) ORDER BY event_no) AS copy FROM stream_events WHERE type = 'message')
WHERE copy = 1 OR session_id IS NULL OR coalesce(lower(regexp_replace(message.id, '^\\s+|\\s+$', '', 'g')), '') = ''""",
    "p4_descendants": f"""WITH RECURSIVE {_TREE}
SELECT session_id, path[k] AS ancestor_id, id, CAST(depth - k + 1 AS BIGINT) AS distance FROM (SELECT *, unnest(range(1, len(path))) AS k FROM down)""",
}
