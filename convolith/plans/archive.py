"""Queries of the archive's own operators over the driver's tables, with the SQL they are checked against.

Sessions stand in their insertion order (segment, block_seq, pos); their messages are joined by id.
Stream events are the event log, in order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolith.functions import metadata, text
from convolith.operators import blocks, browse, events, search, stats
from convolith.shared import materialise
from convolith.sources import export_tree, ingest
from convolith.sources.tables import table

ORDER = ["segment", "block_seq", "pos"]
_PLACE_SQL = "segment, block_seq, pos"
QUERIES = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stream_events").select(F.col("event_no").alias("seq"), "type", "session_id", "message", "metadata_json")


def _found(spark, d, q, after=None, before=None) -> DataFrame:
    return search.matching(_sessions(spark, d), _messages(spark, d), "id", "session_id", q, after, before)


def _hits_sql(q: str) -> str:
    return f"(SELECT session_id FROM messages WHERE contains(lower(content), '{q}'))"


# -- search ----------------------------------------------------------------------------------------


@query(f"SELECT session_no, id, created_at FROM sessions WHERE id IN {_hits_sql('retry loop')}")
def search_literal(spark, d):
    return _found(spark, d, "Retry LOOP").select("session_no", "id", "created_at")


@query(f"SELECT session_no, id, created_at FROM sessions WHERE id IN {_hits_sql('the')} AND (created_at IS NULL OR created_at >= 1718236800) AND (created_at IS NULL OR created_at <= 1720000000)")
def search_time_range(spark, d):
    return _found(spark, d, "the", text.parse_when("2024-06-13"), 1720000000).select("session_no", "id", "created_at")


@query(f"SELECT session_no, id FROM sessions WHERE id IN {_hits_sql('qqq no such words qqq')}")
def search_none(spark, d):
    return _found(spark, d, "qqq no such words qqq").select("session_no", "id")


@query("SELECT session_no, id FROM sessions WHERE id IN (SELECT session_id FROM messages WHERE content IS NOT NULL)")
def search_empty_query(spark, d):
    return _found(spark, d, "").select("session_no", "id")


@query(f"SELECT session_no, id FROM sessions WHERE id IN {_hits_sql('index')} AND created_at IS NULL")
def search_reversed_range(spark, d):
    """After later than before: only undated sessions pass."""
    return _found(spark, d, "index", 1800000000, 1500000000).select("session_no", "id")


@query(f"""SELECT s.session_no, s.id, s.title, s.created_at, count(m.msg_no) AS message_count FROM sessions s JOIN messages m ON m.session_id = s.id
WHERE s.id IN {_hits_sql('lock file')} GROUP BY ALL""")
def search_summary(spark, d):
    counts = _messages(spark, d).groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("message_count"))
    return _found(spark, d, "lock file").join(counts, "id").select("session_no", "id", "title", "created_at", "message_count")


@query(f"""SELECT s.session_no, m.seq, m.msg_no, CASE m.role WHEN 'assistant' THEN 'model' ELSE m.role END AS role FROM sessions s JOIN messages m ON m.session_id = s.id WHERE s.id IN {_hits_sql('lock file')}""")
def search_json(spark, d):
    """The rows of the JSON-lines output: each stored message of each matching session."""
    lines = _found(spark, d, "lock file").join(_messages(spark, d).select(F.col("session_id").alias("id"), "seq", "msg_no", "role"), "id")
    as_json = lines.select("session_no", F.to_json(F.struct("seq", "msg_no", text.normal_role(F.col("role")).alias("role"))).alias("line"))
    return as_json.select("session_no", F.from_json("line", "seq int, msg_no long, role string").alias("m")).select("session_no", "m.*")


_FOLD_SQL = """starts AS (SELECT session_id, min(event_no) AS start_seq, arg_min(metadata_json, event_no) FILTER (metadata_json IS NOT NULL) AS any_metadata FROM stream_events WHERE type = 'session_start' GROUP BY session_id),
ends AS (SELECT e.session_id, min(e.event_no) AS end_seq FROM stream_events e JOIN starts s USING (session_id) WHERE e.type = 'finalize' AND e.event_no > s.start_seq GROUP BY e.session_id),
folded AS (SELECT s.session_id, s.start_seq, e.end_seq FROM starts s LEFT JOIN ends e USING (session_id)),
said AS (SELECT e.session_id, e.event_no, e.message FROM stream_events e JOIN folded f USING (session_id) WHERE e.type = 'message' AND e.event_no > f.start_seq AND f.end_seq IS NOT NULL)"""


@query(f"""WITH {_FOLD_SQL},
p AS (SELECT 0 AS src, f.session_id AS id, 0 AS segment, f.end_seq AS block_seq, 0 AS pos FROM folded f WHERE f.end_seq IS NOT NULL AND f.session_id IN (SELECT session_id FROM said WHERE contains(lower(message.content), 'block index'))),
a AS (SELECT 1 AS src, id, segment, block_seq, pos FROM sessions WHERE id IN {_hits_sql('block index')}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, segment, block_seq, pos) AS rn FROM (FROM p UNION ALL FROM a))
SELECT id, CAST(src AS INT) AS src, CAST(block_seq AS BIGINT) AS block_seq FROM r WHERE rn = 1""")
def search_pending_first(spark, d):
    """Pending hits before archived ones; of an id that hits in both, the pending one."""
    log = _log(spark, d)
    waiting = events.pending_sessions(log)
    said = events.pending_messages(log).select("session_id", F.col("message.content").alias("content"))
    p = search.matching(waiting, said, "id", "session_id", "block index").select(F.lit(0).alias("src"), "id", F.lit(0).alias("segment"), F.col("end_seq").alias("block_seq"), F.lit(0).alias("pos"))
    a = _found(spark, d, "block index").select(F.lit(1).alias("src"), "id", *ORDER)
    return browse.first_wins(p.unionByName(a), "id", "src", *ORDER).select("id", "src", "block_seq")


# -- tokens and the index --------------------------------------------------------------------------

_WORDS = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower({0}), '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: regexp_replace(x, '^[^\\pL\\pM\\pN]+|[^\\pL\\pM\\pN]+$', '', 'g')), lambda x: x <> ''))"


@query(f"SELECT msg_no, unnest({_WORDS.format('content')}) AS token FROM messages WHERE content IS NOT NULL")
def tokens_messages(spark, d):
    return _messages(spark, d).select("msg_no", F.explode(text.tokens(F.col("content"))).alias("token"))


@query(f"SELECT token, count(*) AS documents FROM (SELECT unnest({_WORDS.format('text')}) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token")
def tokens_documents(spark, d):
    return table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("documents"))


_INDEX_SQL = """idx AS (SELECT s.segment, s.block_seq, string_agg(s.id, ',' ORDER BY s.pos) AS ids, count(*) AS session_count, coalesce(sum(m.n), 0) AS message_count,
  CASE WHEN count(*) > count(s.created_at) THEN 0 ELSE min(s.created_at) END AS min_time, CASE WHEN count(*) > count(s.created_at) THEN NULL ELSE max(s.created_at) END AS max_time,
  coalesce(sum(m.bytes), 0) AS uncompressed_bytes
FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS n, sum(coalesce(octet_length(encode(content)), 0)) AS bytes FROM messages GROUP BY session_id) m ON m.session_id = s.id GROUP BY s.segment, s.block_seq)"""


def _index(spark, d) -> DataFrame:
    return search.block_index(_sessions(spark, d), _messages(spark, d), "id", "session_id")


@query(f"WITH {_INDEX_SQL} SELECT segment, block_seq, ids, CAST(session_count AS BIGINT) AS session_count, CAST(message_count AS BIGINT) AS message_count, CAST(min_time AS BIGINT) AS min_time, CAST(max_time AS BIGINT) AS max_time, CAST(uncompressed_bytes AS BIGINT) AS uncompressed_bytes FROM idx")
def block_index(spark, d):
    return _index(spark, d).withColumn("ids", F.array_join("session_ids", ",")).drop("session_ids")


@query(f"WITH {_INDEX_SQL} SELECT segment, block_seq FROM idx WHERE (max_time IS NULL OR max_time >= 1718236800) AND min_time <= 1719000000")
def block_prune_time(spark, d):
    return search.overlapping_blocks(_index(spark, d), 1718236800, 1719000000).select("segment", "block_seq")


_TOKENS_SQL = f"tok AS (SELECT DISTINCT s.segment, s.block_seq, t.token FROM (SELECT session_id, unnest({_WORDS.format('content')}) AS token FROM messages WHERE content IS NOT NULL) t JOIN sessions s ON s.id = t.session_id)"
_GATE_SQL = "gate AS (SELECT segment, block_seq FROM tok WHERE token IN ('write', 'ahead', 'write-ahead', 'log') AND token IN ('write-ahead', 'log') GROUP BY segment, block_seq HAVING count(*) = 2)"


def _token_index(spark, d) -> DataFrame:
    return search.token_index(_sessions(spark, d), _messages(spark, d), "id", "session_id")


@query(f"WITH {_TOKENS_SQL}, {_GATE_SQL} FROM gate")
def block_gate_tokens(spark, d):
    return search.gated_blocks(_token_index(spark, d), "write-ahead LOG")


@query(f"WITH {_TOKENS_SQL}, {_GATE_SQL} SELECT s.session_no, s.id FROM sessions s SEMI JOIN gate g ON s.segment = g.segment AND s.block_seq = g.block_seq WHERE s.id IN {_hits_sql('write-ahead log')} AND (s.created_at IS NULL OR s.created_at >= 1718236800)")
def search_indexed(spark, d):
    messages = _messages(spark, d)
    return search.search_indexed(_sessions(spark, d), messages, _index(spark, d), _token_index(spark, d), "id", "session_id", "write-ahead log", 1718236800).select("session_no", "id")


@query(f"""WITH {_TOKENS_SQL}, known AS (SELECT segment, block_seq FROM (SELECT DISTINCT segment, block_seq FROM sessions) WHERE block_seq % 2 = 0),
gate AS (SELECT segment, block_seq FROM tok WHERE token = 'stream' GROUP BY segment, block_seq)
SELECT s.session_no, s.id FROM sessions s WHERE s.id IN {_hits_sql('stream')}
AND (NOT EXISTS (FROM known k WHERE k.segment = s.segment AND k.block_seq = s.block_seq) OR EXISTS (FROM gate g WHERE g.segment = s.segment AND g.block_seq = s.block_seq))""")
def search_unindexed_tail(spark, d):
    """Where the index knows only every second block, the others are read and verified."""
    half = _index(spark, d).where("block_seq % 2 = 0")
    return search.search_indexed(_sessions(spark, d), _messages(spark, d), half, _token_index(spark, d), "id", "session_id", "stream").select("session_no", "id")


@query("SELECT segment, count(DISTINCT block_seq) AS blocks FROM sessions GROUP BY segment")
def segments(spark, d):
    return _sessions(spark, d).groupBy("segment").agg(F.countDistinct("block_seq").alias("blocks"))


@query("SELECT count(*) AS blocks FROM (SELECT DISTINCT segment, block_seq FROM sessions)")
def block_count(spark, d):
    return _sessions(spark, d).select("segment", "block_seq").distinct().agg(F.count("*").alias("blocks"))


@query("SELECT coalesce(max(segment), 1) AS segment FROM sessions")
def active_segment(spark, d):
    return _sessions(spark, d).agg(F.coalesce(F.max("segment"), F.lit(1)).alias("segment"))


@query("SELECT DISTINCT segment, block_seq FROM sessions WHERE id = (SELECT min(id) FROM sessions)")
def id_membership(spark, d):
    wanted = _sessions(spark, d).agg(F.min("id").alias("wanted"))
    return _index(spark, d).join(F.broadcast(wanted), F.array_contains("session_ids", F.col("wanted"))).select("segment", "block_seq")  # one row


@query(f"WITH {_INDEX_SQL} SELECT segment, block_seq, (max_time IS NULL OR min_time <= max_time) AND session_count > 0 AS valid FROM idx")
def index_checks(spark, d):
    return _index(spark, d).select("segment", "block_seq", ((F.col("max_time").isNull() | (F.col("min_time") <= F.col("max_time"))) & (F.col("session_count") > 0)).alias("valid"))


@query("SELECT count(*) AS reindexed FROM sessions")
def reindex_count(spark, d):
    return _index(spark, d).agg(F.sum("session_count").alias("reindexed"))


# -- statistics ------------------------------------------------------------------------------------


@query(f"WITH {_INDEX_SQL} SELECT CAST(sum(session_count) AS BIGINT) AS session_count, CAST(sum(message_count) AS BIGINT) AS message_count, CAST(sum(uncompressed_bytes) AS BIGINT) AS data_uncompressed_bytes, CAST(coalesce(min(CASE WHEN min_time > 0 THEN min_time END), 0) AS BIGINT) AS min_time, CAST(coalesce(max(max_time), 0) AS BIGINT) AS max_time FROM idx")
def stats_index(spark, d):
    return stats.from_index(_index(spark, d))


@query("SELECT (SELECT count(*) FROM sessions) AS session_count, (SELECT count(*) FROM messages) AS message_count, CAST(coalesce(min(CASE WHEN created_at > 0 THEN created_at END), 0) AS BIGINT) AS min_time, CAST(coalesce(max(created_at), 0) AS BIGINT) AS max_time FROM sessions")
def stats_scan(spark, d):
    return stats.from_scan(_sessions(spark, d), _messages(spark, d))


@query(f"""WITH {_FOLD_SQL} SELECT CAST((SELECT count(*) FROM sessions) + (SELECT count(*) FROM folded WHERE end_seq IS NOT NULL) AS BIGINT) AS session_count, CAST((SELECT count(*) FROM messages) + (SELECT count(*) FROM said) AS BIGINT) AS message_count""")
def stats_with_pending(spark, d):
    log = _log(spark, d)
    waiting = stats.from_scan(events.pending_sessions(log), events.pending_messages(log))
    return stats.with_pending(stats.from_scan(_sessions(spark, d), _messages(spark, d)), waiting).select("session_count", "message_count")


# -- browsing --------------------------------------------------------------------------------------

_SCAN_SQL = f"scan AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_PLACE_SQL}) AS rn FROM sessions) WHERE rn = 1)"


def _scan(spark, d) -> DataFrame:
    return browse.first_wins(_sessions(spark, d), "id", *ORDER)


@query(f"WITH {_SCAN_SQL} SELECT session_no, id FROM scan ORDER BY {_PLACE_SQL} LIMIT 10")
def first_n(spark, d):
    return browse.first_n(_scan(spark, d), ORDER).select("session_no", "id")


@query(f"WITH {_SCAN_SQL} SELECT session_no, id FROM scan ORDER BY segment DESC, block_seq DESC, pos DESC LIMIT 7")
def last_n(spark, d):
    return browse.last_n(_scan(spark, d), ORDER, 7).select("session_no", "id")


@query(f"WITH {_SCAN_SQL} SELECT session_no, id FROM scan ORDER BY segment DESC, block_seq DESC, pos DESC LIMIT 10")
def recent_n(spark, d):
    return browse.recent_n(_scan(spark, d), ORDER, "ten").select("session_no", "id")


@query("""SELECT s.session_no, s.id, coalesce(s.title, 'Untitled') AS title, count(m.msg_no) AS message_count,
CASE WHEN octet_length(encode(arg_min(m.content, m.seq))) > 60 THEN left(arg_min(m.content, m.seq), 60) || '...' ELSE arg_min(m.content, m.seq) END AS preview
FROM sessions s LEFT JOIN messages m ON m.session_id = s.id GROUP BY s.session_no, s.id, s.title""")
def list_preview(spark, d):
    return browse.list_rows(_sessions(spark, d), _messages(spark, d), "id", "session_id").select("session_no", "id", "title", "message_count", "preview")


@query(f"""WITH one AS (SELECT * FROM sessions WHERE id = (SELECT min(session_id) FROM messages) ORDER BY {_PLACE_SQL} LIMIT 1)
SELECT o.session_no, o.id, m.seq AS number, CASE m.role WHEN 'assistant' THEN 'model' ELSE m.role END AS role, m.content FROM one o JOIN messages m ON m.session_id = o.id""")
def show_session(spark, d):
    wanted = _messages(spark, d).agg(F.min("session_id").alias("wanted"))
    one = browse.first_n(_sessions(spark, d).join(F.broadcast(wanted), F.col("id") == F.col("wanted")), ORDER, 1)
    said = _messages(spark, d).select(F.col("session_id").alias("id"), F.col("seq").alias("number"), text.normal_role(F.col("role")).alias("role"), "content")
    return one.select("session_no", "id").join(said, "id")


@query("SELECT session_no, id FROM sessions WHERE id = 'there is no such session'")
def show_missing(spark, d):
    return _sessions(spark, d).where(F.col("id") == "there is no such session").select("session_no", "id")


@query(f"""WITH {_FOLD_SQL},
b AS (SELECT 0 AS src, session_id AS id, 0 AS segment, end_seq AS block_seq, 0 AS pos FROM folded WHERE end_seq IS NOT NULL UNION ALL SELECT 1, id, segment, block_seq, pos FROM sessions)
SELECT id, CAST(src AS INT) AS src FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, {_PLACE_SQL}) AS rn FROM b) WHERE rn = 1""")
def show_precedence(spark, d):
    """Point lookup of every id: pending before archive, then the earliest."""
    return browse.first_wins(_all(spark, d), "id", "src", *ORDER).select("id", "src")


def _all(spark, d) -> DataFrame:
    p = events.pending_sessions(_log(spark, d)).select(F.lit(0).alias("src"), "id", F.lit(0).alias("segment"), F.col("end_seq").alias("block_seq"), F.lit(0).alias("pos"))
    return p.unionByName(_sessions(spark, d).select(F.lit(1).alias("src"), "id", *ORDER))


@query(f"""WITH {_FOLD_SQL},
b AS (SELECT 0 AS src, session_id AS id, 0 AS segment, end_seq AS block_seq, 0 AS pos FROM folded WHERE end_seq IS NOT NULL UNION ALL SELECT 1, id, segment, block_seq, pos FROM sessions)
SELECT id, CAST(src AS INT) AS src, CAST(block_seq AS BIGINT) AS block_seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src DESC, {_PLACE_SQL}) AS rn FROM b) WHERE rn = 1""")
def dedup_archive_wins(spark, d):
    return browse.first_wins(_all(spark, d), "id", F.desc("src"), *ORDER).select("id", "src", "block_seq")


@query(f"""WITH {_FOLD_SQL},
b AS (SELECT 0 AS src, session_id AS id, 0 AS segment, end_seq AS block_seq, 0 AS pos FROM folded WHERE end_seq IS NOT NULL UNION ALL SELECT 1, id, segment, block_seq, pos FROM sessions)
SELECT id, CAST(src AS INT) AS src, CAST(block_seq AS BIGINT) AS block_seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, {_PLACE_SQL}) AS rn FROM b) WHERE rn = 1""")
def dedup_pending_wins(spark, d):
    return browse.first_wins(_all(spark, d), "id", "src", *ORDER).select("id", "src", "block_seq")


@query("SELECT role, count(*) AS messages FROM (SELECT unnest([message.role]) AS role FROM stream_events WHERE type = 'message') GROUP BY role")
def role_counts(spark, d):
    return _log(spark, d).where("type = 'message'").groupBy(F.col("message.role").alias("role")).agg(F.count("*").alias("messages"))


@query("SELECT event_no, CASE WHEN message.role = 'assistant' THEN 'model' WHEN message.role IN ('user', 'system', 'model', 'thought', 'tool') THEN message.role END AS role FROM stream_events WHERE type = 'message'")
def role_normalise(spark, d):
    return _log(spark, d).where("type = 'message'").select(F.col("seq").alias("event_no"), text.normal_role(F.col("message.role")).alias("role"))


@query("SELECT session_id, md5(string_agg(content || ' ', '' ORDER BY seq)) AS digest FROM messages WHERE content IS NOT NULL GROUP BY session_id")
def full_text(spark, d):
    joined = _messages(spark, d).where("content is not null").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat("content", F.lit(" ")).alias("c")))).alias("m"))
    return joined.select("session_id", F.md5(F.array_join(F.transform("m", lambda x: x["c"]), "")).alias("digest"))


# -- the event log ---------------------------------------------------------------------------------


@query(f"WITH {_FOLD_SQL} SELECT f.session_id, f.start_seq, f.end_seq, count(s.event_no) AS messages FROM folded f LEFT JOIN said s USING (session_id) WHERE f.end_seq IS NOT NULL GROUP BY ALL")
def wal_fold(spark, d):
    log = _log(spark, d)
    counts = events.pending_messages(log).groupBy("session_id").agg(F.count("*").alias("messages"))
    return events.folded(log).where("end_seq is not null").join(counts, "session_id", "left").select("session_id", "start_seq", "end_seq", F.coalesce("messages", F.lit(0)).alias("messages"))


@query(f"WITH {_FOLD_SQL} SELECT session_id, event_no, row_number() OVER (PARTITION BY session_id ORDER BY event_no) AS turn_no FROM said")
def wal_messages(spark, d):
    """Numbered messages of finished sessions; the hot session is numbered by ranges, not in one task."""
    said = events.pending_messages(_log(spark, d)).select("session_id", F.col("seq").alias("event_no"))
    rows = blocks.ranked(said, ["session_id", "event_no"])
    first = rows.groupBy("session_id").agg(F.min("rn").alias("first"))
    return rows.join(first, "session_id").select("session_id", "event_no", (F.col("rn") - F.col("first") + 1).alias("turn_no"))


@query(f"WITH {_FOLD_SQL} SELECT e.event_no, e.type FROM stream_events e LEFT JOIN folded f USING (session_id) WHERE e.type <> 'session_start' AND (f.start_seq IS NULL OR e.event_no < f.start_seq)")
def wal_orphans(spark, d):
    return events.orphans(_log(spark, d)).select(F.col("seq").alias("event_no"), "type")


@query(f"WITH {_FOLD_SQL} SELECT session_id, start_seq FROM folded WHERE end_seq IS NULL")
def wal_unfinished(spark, d):
    return events.unfinished(_log(spark, d)).select("session_id", "start_seq")


@query(f"WITH {_FOLD_SQL} SELECT event_no FROM stream_events WHERE session_id NOT IN (SELECT session_id FROM folded WHERE end_seq IS NOT NULL)")
def wal_compact(spark, d):
    log = _log(spark, d)
    return events.compacted(log, events.folded(log).where("end_seq is not null")).select(F.col("seq").alias("event_no"))


@query(f"WITH {_FOLD_SQL} SELECT session_id AS id, end_seq FROM folded WHERE end_seq IS NOT NULL AND session_id NOT IN (SELECT id FROM sessions)")
def flush_idempotent(spark, d):
    """What a flush would archive: finished sessions that are not archived yet."""
    return events.to_archive(_log(spark, d), _sessions(spark, d)).select("id", "end_seq")


@query("""WITH s AS (SELECT session_id, arg_min(event_no, event_no) AS event_no FROM stream_events WHERE type = 'session_start' GROUP BY session_id),
m AS (SELECT e.event_no, TRY_CAST(e.metadata_json AS JSON) AS j FROM stream_events e SEMI JOIN s ON e.event_no = s.event_no)
SELECT event_no, CASE WHEN json_type(j, '$.title') = 'VARCHAR' THEN json_extract_string(j, '$.title') END AS title, CASE WHEN json_type(j, '$.source') = 'VARCHAR' THEN json_extract_string(j, '$.source') END AS source,
CASE WHEN json_type(j, '$.model') = 'VARCHAR' THEN json_extract_string(j, '$.model') END AS model, CASE WHEN json_type(j, '$.created_at') = 'UBIGINT' THEN CAST(json_extract_string(j, '$.created_at') AS BIGINT) END AS created_at FROM m""")
def metadata_hoist(spark, d):
    first = _log(spark, d).where("type = 'session_start'").groupBy("session_id").agg(F.min_by(F.struct("seq", "metadata_json"), "seq").alias("s"))
    fields = metadata.hoist(F.col("s.metadata_json"))
    return first.select(F.col("s.seq").alias("event_no"), *[(c.cast("long") if k == "created_at" else c).alias(k) for k, c in fields.items()])


@query("""SELECT event_no, k AS key FROM (SELECT event_no, unnest(json_keys(metadata_json)) AS k FROM stream_events WHERE type = 'session_start' AND metadata_json IS NOT NULL) WHERE k NOT IN ('title', 'source', 'model', 'created_at')""")
def metadata_rest(spark, d):
    rows = _log(spark, d).where("type = 'session_start' and metadata_json is not null")
    return rows.select(F.col("seq").alias("event_no"), F.explode(F.map_keys(metadata.rest(F.col("metadata_json")))).alias("key"))


@query("""WITH own AS (SELECT session_no, unnest(['title', 'source', 'model', 'created_at']) AS key, unnest([title, source, model, CAST(created_at AS VARCHAR)]) AS value FROM sessions)
SELECT session_no, key FROM own WHERE value IS NOT NULL UNION ALL SELECT session_no, k FROM (SELECT session_no, unnest(json_keys(metadata_json)) AS k FROM sessions) WHERE k NOT IN ('title', 'source', 'model', 'created_at')""")
def metadata_sink(spark, d):
    own = {k: F.col(k) for k in ("title", "source", "model", "created_at")}
    rows = _sessions(spark, d).select("session_no", metadata.sink(F.col("metadata_json"), own).alias("j"))
    return rows.select("session_no", F.explode(F.json_object_keys("j")).alias("key"))


@query("SELECT session_no, CASE WHEN json_type(metadata_json, '$.source_url') = 'VARCHAR' THEN json_extract_string(metadata_json, '$.source_url') END AS source_url, CASE WHEN json_type(metadata_json, '$.score') = 'UBIGINT' THEN CAST(json_extract_string(metadata_json, '$.score') AS BIGINT) END AS score FROM sessions")
def json_key(spark, d):
    v = F.try_parse_json("metadata_json")
    return _sessions(spark, d).select("session_no", metadata.typed_string(v, "source_url").alias("source_url"), metadata.typed_seconds(v, "score").cast("long").alias("score"))


# -- blocks ----------------------------------------------------------------------------------------


@query(f"SELECT session_no, CAST(floor((rn - 1) / 100) AS BIGINT) AS block_no, CAST((rn - 1) % 100 AS INT) AS pos FROM (SELECT session_no, row_number() OVER (ORDER BY {_PLACE_SQL}) AS rn FROM sessions)")
def bulk_blocks_100(spark, d):
    rows = _sessions(spark, d).select("session_no", *[F.col(c).alias(f"at_{c}") for c in ORDER])
    return blocks.bulk_blocks(rows, [f"at_{c}" for c in ORDER]).select("session_no", "block_no", "pos")


_SIZES_SQL = "sizes AS (SELECT s.session_no, s.segment, s.block_seq, s.pos, coalesce(m.bytes, 0) AS bytes FROM sessions s LEFT JOIN (SELECT session_id, sum(coalesce(octet_length(encode(content)), 0)) AS bytes FROM messages GROUP BY session_id) m ON m.session_id = s.id)"


def _sizes(spark, d) -> DataFrame:
    bytes_ = _messages(spark, d).groupBy(F.col("session_id").alias("id")).agg(F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).alias("bytes"))
    return _sessions(spark, d).join(bytes_, "id", "left").select("session_no", *ORDER, F.coalesce("bytes", F.lit(0)).alias("bytes"))


@query(f"WITH {_SIZES_SQL} SELECT session_no, CAST(floor((sum(bytes) OVER (ORDER BY {_PLACE_SQL} ROWS UNBOUNDED PRECEDING) - bytes) / 65536) AS BIGINT) AS block_no FROM sizes")
def size_packing(spark, d):
    """Blocks by running bytes: the approximation of greedy packing."""
    return blocks.size_blocks(_sizes(spark, d), ORDER, F.col("bytes"), 65536).select("session_no", "block_no")


@query(f"""WITH RECURSIVE {_SIZES_SQL}, o AS (SELECT session_no, CAST(bytes AS BIGINT) AS bytes, row_number() OVER (ORDER BY {_PLACE_SQL}) AS rn FROM sizes),
f AS (SELECT rn, session_no, CAST(1 AS BIGINT) AS segment_no, bytes AS held FROM o WHERE rn = 1 UNION ALL
  SELECT o.rn, o.session_no, CASE WHEN f.held >= 20000 THEN f.segment_no + 1 ELSE f.segment_no END, CASE WHEN f.held >= 20000 THEN o.bytes ELSE f.held + o.bytes END FROM f JOIN o ON o.rn = f.rn + 1)
SELECT session_no, segment_no FROM f""")
def rotation_segments(spark, d):
    """A block of its own each, a segment is left once it holds 20 000 bytes."""
    return blocks.segments(_sizes(spark, d), ORDER, F.col("bytes"), 20_000).select("session_no", "segment_no")


@query("SELECT count(*) AS sessions, count(DISTINCT session_no) AS once, true AS in_order FROM sessions")
def optimise_invariants(spark, d):
    """Greedy packing by trial compression keeps every session once and in order."""
    said = _messages(spark, d).groupBy(F.col("session_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), " ").alias("text"))
    rows = _sessions(spark, d).join(said, "id", "left").select("session_no", *ORDER, "text")
    packed = materialise(blocks.greedy_blocks(rows, "segment", ["block_seq", "pos", "session_no"], "text", 16_384), "packed")
    spans = packed.groupBy("segment", "block_no").agg(F.min(F.struct("block_seq", "pos")).alias("a"), F.max(F.struct("block_seq", "pos")).alias("b"))
    ordered = spans.alias("x").join(spans.alias("y"), (F.col("x.segment") == F.col("y.segment")) & (F.col("y.block_no") == F.col("x.block_no") + 1)).agg(F.coalesce(F.every(F.col("x.b") < F.col("y.a")), F.lit(True)).alias("in_order"))
    counts = packed.agg(F.count("*").alias("sessions"), F.countDistinct("session_no").alias("once"))
    both = counts.withColumn("in_order", F.lit(None).cast("boolean")).unionByName(ordered, allowMissingColumns=True)
    return both.agg(F.max("sessions").alias("sessions"), F.max("once").alias("once"), F.every("in_order").alias("in_order"))


# -- ingest ----------------------------------------------------------------------------------------


@query("SELECT input_no, id, title, source, model, created_at FROM session_inputs WHERE created_at IS NULL OR created_at >= 0")
def session_inputs(spark, d):
    """Each input record as one JSON document, read strictly again."""
    inputs = table(spark, d, "session_inputs").where("created_at is null or created_at >= 0")
    own = F.struct("id", "title", "source", "model", "created_at")
    checked = ingest.checked_sessions(inputs.select("input_no", F.to_json(own).alias("json")), "json").where("problem is null")
    return checked.select("input_no", F.col("session_id").alias("id"), F.col("session_title").alias("title"), F.col("session_source").alias("source"), F.col("session_model").alias("model"), F.col("session_created_at").cast("long").alias("created_at"))


@query("SELECT m.session_id, count(*) AS messages FROM messages m GROUP BY m.session_id")
def export_walk(spark, d):
    """Each session's messages as the tree of an export, a chain of nodes, walked from its last one."""
    rows = _messages(spark, d)
    # the two columns a node needs, for every session; sessions beyond this many messages would be read from files
    node = F.struct(
        F.concat(F.lit("n"), "seq").alias("id"),
        F.when(F.col("seq") > 1, F.concat(F.lit("n"), F.col("seq") - 1)).alias("parent"),
        F.struct(F.col("msg_no").cast("string").alias("id"), F.struct(F.coalesce("role", F.lit("user")).alias("role")).alias("author"), F.struct(F.lit("text").alias("content_type"), F.array(F.concat(F.lit("."), F.coalesce("content", F.lit("")))).alias("parts")).alias("content")).alias("message"),
    )
    trees = rows.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), "seq").alias("k"), node.alias("v")))).alias("mapping"), F.concat(F.lit("n"), F.max("seq")).alias("current_node"))
    documents = trees.select("session_id", F.to_json(F.struct(F.col("session_id").alias("id"), "mapping", "current_node")).alias("json"))
    return export_tree.export_sessions(documents, "json").select("session_id", F.size("messages").cast("long").alias("messages"))


@query("SELECT * FROM (VALUES (1, 'ab'), (2, ''), (3, ''), (4, 'x'), (5, '')) t(row_no, joined)")
def export_parts(spark, d):
    rows = spark.sql("""select * from values (1, '["a", {"o": 1}, "b"]'), (2, '[]'), (3, null), (4, '["x", 5, null]'), (5, '[["y"]]') as t(row_no, json)""")
    return rows.select("row_no", export_tree.joined_parts(F.from_json("json", "array<variant>")).alias("joined"))


@query("SELECT * FROM (VALUES (1, 20240101), (2, 1704067200), (3, NULL), (4, 0), (5, NULL), (6, 1709164800)) t(row_no, seconds)")
def date_parse(spark, d):
    rows = spark.sql("select * from values (1, '20240101'), (2, '2024-01-01'), (3, 'soon'), (4, '1960-05-05'), (5, '2024-13-01'), (6, '2024-2-29') as t(row_no, w)")
    return rows.select("row_no", text.seconds_of(F.col("w")).cast("int").alias("seconds"))


@query("SELECT session_no, strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S UTC') AS created FROM sessions")
def date_format(spark, d):
    return _sessions(spark, d).select("session_no", text.format_seconds(F.col("created_at")).alias("created"))


@query("SELECT (SELECT count(*) FROM stream_events WHERE type = 'message' AND length(regexp_replace(message.content, '[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', '', 'g')) > 0) AS lines")
def blank_lines(spark, d):
    return _log(spark, d).where("type = 'message'").where(~text.is_blank(F.col("message.content"))).agg(F.count("*").alias("lines"))


@query("SELECT printf('%.2f', sum(octet_length(encode(coalesce(content, '')))) / 1048576.0) AS megabytes FROM messages")
def disk_megabytes(spark, d):
    return _messages(spark, d).agg(F.sum(F.octet_length(F.coalesce("content", F.lit("")))).alias("b")).select(text.megabytes(F.col("b")).alias("megabytes"))


@query(f"WITH {_FOLD_SQL} SELECT (SELECT count(*) FROM said) AS messages, CAST(0 AS BIGINT) AS differing")
def stream_equals_batch(spark, d):
    """Sessions folded by the stateful stream against the batch fold: messages, and how many differ.

    The events arrive in four batches, by their number, cut without regard to sessions.
    """
    from convolith.shared import scratch_path
    from convolith.streaming.sessionizer import sessionized

    log = _log(spark, d)
    place, state, out = (scratch_path(spark, x) for x in ("events", "state", "folded"))
    cuts = [float("-inf"), *log.approxQuantile("seq", [0.25, 0.5, 0.75], 0.01), float("inf")]
    for low, high in zip(cuts, cuts[1:], strict=False):
        log.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(place)
    stream = sessionized(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(place))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    folded = spark.read.schema(stream.schema).parquet(out).select("session_id", "seq")
    batch = events.pending_messages(log).select("session_id", "seq")
    both = folded.withColumn("by", F.lit(1)).unionByName(batch.withColumn("by", F.lit(-1)))
    each = both.groupBy("session_id", "seq").agg(F.sum("by").alias("by"))
    return each.agg(F.count("*").alias("messages"), F.count(F.when(F.col("by") != 0, 1)).alias("differing"))


@query(f"WITH {_TOKENS_SQL}, held AS (SELECT DISTINCT session_no FROM sessions WHERE id IN {_hits_sql('lock')}) SELECT count(*) AS literal FROM held")
def search_counts(spark, d):
    return _found(spark, d, "lock").agg(F.count("*").alias("literal"))
