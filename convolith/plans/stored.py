"""Queries that go through a stored archive: built from the driver's tables, changed, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolith.archive import Archive
from convolith.functions import text
from convolith.operators import blocks, events
from convolith.plans.archive import _FOLD_SQL, _WORDS, ORDER, _hits_sql, _log, _messages, _sessions
from convolith.shared import passing, scratch_path
from convolith.sources import export_tree, ingest

QUERIES = {}
ORACLE: dict[str, str] = {}
_BUILT: dict[tuple[str, str], Archive] = {}
_FIELDS = ("content", "tool_calls", "tool_outputs", "id", "parent_id", "metadata_json")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _new(spark: SparkSession, d: str) -> Archive:
    """An archive of the sessions in their order, with their messages, in blocks of a hundred."""
    archive = Archive(spark, scratch_path(spark, "archive"))
    with passing(spark):
        rows = blocks.ranked(_sessions(spark, d), ORDER).select(F.col("rn").alias("ord"), "id", "title", "source", "model", "created_at", "metadata_json")
        said = _messages(spark, d).select("session_id", "seq", text.normal_role(F.col("role")).alias("role"), *_FIELDS)
        messages = said.join(rows.select("ord", F.col("id").alias("session_id")), "session_id").select("ord", "seq", "role", *_FIELDS)
        archive.append_tables(rows, messages)
    return archive


def _built(spark: SparkSession, d: str) -> Archive:
    """One for each context and folder, for queries that change nothing."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        _BUILT[key] = _new(spark, d)
    return _BUILT[key]


def _numbered(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """The order in which a few rows come out, as numbers."""
    return spark.createDataFrame([(k + 1, r["id"]) for k, r in enumerate(rows.select("id").collect())], "number int, id string")


_ORD = "ord AS (SELECT *, row_number() OVER (ORDER BY segment, block_seq, pos) - 1 AS rn FROM sessions)"
_ONCE = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn) AS copy FROM ord) WHERE copy = 1)"
_SAID = "n AS (SELECT session_id, count(*) AS n FROM messages GROUP BY session_id)"
_ROLE = "CASE m.role WHEN 'assistant' THEN 'model' WHEN 'user' THEN 'user' WHEN 'system' THEN 'system' WHEN 'model' THEN 'model' WHEN 'thought' THEN 'thought' WHEN 'tool' THEN 'tool' END"


@query(f"WITH {_ORD}, {_ONCE}, {_SAID} SELECT o.id, o.title, o.created_at, coalesce(n.n, 0) AS message_count FROM once o LEFT JOIN n ON n.session_id = o.id")
def stored_scan(spark, d):
    return _built(spark, d).scan().select("id", "title", F.col("created_at").cast("long").alias("created_at"), "message_count")


@query(f"SELECT s.id AS session, m.seq, {_ROLE} AS role, m.content, m.id, m.parent_id, m.metadata_json, len(m.tool_calls) AS n_calls, m.tool_outputs[1].content AS output FROM sessions s JOIN messages m ON m.session_id = s.id")
def stored_messages(spark, d):
    """Every message of every stored session, as it was written."""
    a = _built(spark, d)
    owner = a.sessions().select("segment", "block_seq", "pos", F.col("id").alias("session"))
    n_calls = F.when(F.col("tool_calls").isNotNull(), F.size("tool_calls")).cast("long")
    return a.messages().join(owner, ["segment", "block_seq", "pos"]).select("session", F.col("seq").cast("int").alias("seq"), "role", "content", "id", "parent_id", "metadata_json", n_calls.alias("n_calls"), F.try_element_at("tool_outputs", F.lit(1))["content"].alias("output"))


@query(f"WITH {_ORD} SELECT CAST(rn // 100 AS BIGINT) AS block_seq, CAST(rn % 100 AS INT) AS pos, id, title FROM ord WHERE rn // 100 = 3")
def stored_block(spark, d):
    """One block, read alone."""
    a = _built(spark, d)
    place = a.block_index().where("block_seq = 3").select("segment", "block_seq")
    return a._within(a.manifest(), place, ("sessions",))[0].select("block_seq", "pos", "id", "title")


@query("SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS blocks FROM sessions")
def stored_block_count(spark, d):
    """From the manifest, without reading data."""
    return spark.createDataFrame([(_built(spark, d).block_count(),)], "blocks long")


@query("SELECT CAST(1 AS INT) AS segment")
def stored_segments(spark, d):
    return spark.createDataFrame([(n,) for n in _built(spark, d).segments()], "segment int")


_GATED = f"""tok AS (SELECT DISTINCT o.rn // 100 AS block, t.token FROM (SELECT session_id, unnest({_WORDS.format('content')}) AS token FROM messages WHERE content IS NOT NULL) t JOIN ord o ON o.id = t.session_id),
gate AS (SELECT block FROM tok WHERE token IN ('write-ahead', 'log') GROUP BY block HAVING count(*) = 2)"""


@query(f"WITH {_ORD}, {_GATED} SELECT DISTINCT id FROM ord WHERE rn // 100 IN (SELECT block FROM gate) AND id IN {_hits_sql('write-ahead log')} AND (created_at IS NULL OR created_at >= 1718236800)")
def stored_search(spark, d):
    """By the stored index: only blocks it names are read."""
    return _built(spark, d).search("Write-ahead LOG", after=1718236800).select("id")


@query(f"SELECT DISTINCT id FROM sessions WHERE id IN {_hits_sql('write-ahead log')} AND (created_at IS NULL OR created_at >= 1718236800)")
def stored_search_literal(spark, d):
    return _built(spark, d).search("Write-ahead LOG", after=1718236800, mode="literal").select("id")


@query(f"SELECT m.seq AS number, {_ROLE} AS role, m.content FROM messages m WHERE m.session_id = (SELECT max(session_id) FROM messages)")
def stored_get(spark, d):
    wanted = _messages(spark, d).agg(F.max("session_id")).first()[0]
    got = _built(spark, d).get(wanted).select(F.posexplode("messages").alias("k", "m"))
    return got.select((F.col("k") + 1).alias("number"), "m.role", "m.content")


@query(f"WITH {_ORD}, {_ONCE} SELECT CAST(row_number() OVER (ORDER BY rn) AS INT) AS number, id FROM once ORDER BY rn LIMIT 12")
def stored_first(spark, d):
    return _numbered(_built(spark, d).first(12), spark)


@query(f"WITH {_ORD}, {_ONCE} SELECT CAST(row_number() OVER (ORDER BY rn) AS INT) AS number, id FROM (SELECT * FROM once ORDER BY rn DESC LIMIT 12)")
def stored_last(spark, d):
    return _numbered(_built(spark, d).last(12), spark)


@query(f"WITH {_ORD}, {_ONCE} SELECT CAST(row_number() OVER (ORDER BY rn DESC) AS INT) AS number, id FROM once ORDER BY rn DESC LIMIT 12")
def stored_recent(spark, d):
    return _numbered(_built(spark, d).recent(12), spark)


@query("""SELECT count(*) AS session_count, (SELECT count(*) FROM sessions JOIN messages ON session_id = sessions.id) AS message_count,
  (SELECT CAST(coalesce(sum(octet_length(encode(content))), 0) AS BIGINT) FROM sessions JOIN messages ON session_id = sessions.id) AS bytes, max(created_at) AS max_time FROM sessions
WHERE true""")
def stored_stats(spark, d):
    """From the stored index; blocks with undated sessions have no upper bound, so the latest time is taken from the rows."""
    a = _built(spark, d)
    s = a.stats()
    latest = a.sessions().agg(F.max("created_at").cast("long")).first()[0]
    return spark.createDataFrame([(s["session_count"], s["message_count"], s["data_uncompressed_bytes"], latest)], "session_count long, message_count long, bytes long, max_time long")


@query(f"""WITH {_ORD}, {_SAID}, b AS (SELECT CAST(rn // 100 AS BIGINT) AS block_seq, string_agg(id, ',' ORDER BY rn) AS ids, count(*) AS session_count, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS message_count FROM ord LEFT JOIN n ON n.session_id = ord.id GROUP BY ALL)
SELECT *, true AS fits, (SELECT count(*) FROM sessions) AS reindexed FROM b""")
def stored_reindex(spark, d):
    """The index is dropped and built again from the rows; compressed bytes never exceed the others."""
    a = _new(spark, d)
    a.drop_index()
    n = a.reindex()
    fits = F.col("compressed_bytes") <= F.col("uncompressed_bytes")
    return a.block_index().select("block_seq", F.array_join("session_ids", ",").alias("ids"), "session_count", "message_count", fits.alias("fits"), F.lit(n).cast("long").alias("reindexed"))


@query("SELECT s.id AS session, m.seq, md5(m.content) AS digest FROM sessions s JOIN messages m ON m.session_id = s.id")
def stored_optimise(spark, d):
    """Repacked by trial compression: every message of every session is still there, each block's positions dense."""
    a = _new(spark, d)
    a.optimise(16_384)
    owner = a.sessions().select("segment", "block_seq", "pos", F.col("id").alias("session"))
    dense = a.sessions().groupBy("segment", "block_seq").agg((F.max("pos") + 1 == F.count("*")).alias("dense")).where("dense")
    return a.messages().join(owner, ["segment", "block_seq", "pos"]).join(dense.drop("dense"), ["segment", "block_seq"]).select("session", F.col("seq").cast("int").alias("seq"), F.md5("content").alias("digest"))


_FLUSHED = f"""WITH {_FOLD_SQL}, {_ORD}, {_ONCE}, {_SAID},
f AS (SELECT session_id, count(s.event_no) AS n FROM folded LEFT JOIN said s USING (session_id) WHERE end_seq IS NOT NULL AND session_id NOT IN (SELECT id FROM sessions) GROUP BY session_id)"""


@query(f"{_FLUSHED} SELECT o.id, coalesce(n.n, 0) AS message_count FROM once o LEFT JOIN n ON n.session_id = o.id UNION ALL SELECT session_id, n FROM f")
def stored_flush(spark, d):
    """All events are logged and flushed: finished sessions stand in the archive, once each."""
    a = _new(spark, d)
    a.append_events(_log(spark, d))
    a.flush()
    a.flush()
    return a.scan().select("id", "message_count")


@query(f"WITH {_FOLD_SQL} SELECT event_no FROM stream_events WHERE session_id NOT IN (SELECT session_id FROM folded WHERE end_seq IS NOT NULL)")
def stored_flush_rest(spark, d):
    """What stays in the log."""
    a = _new(spark, d)
    a.append_events(_log(spark, d))
    a.flush()
    return a.events().select(F.col("seq").alias("event_no"))


@query(f"""WITH {_FOLD_SQL},
p AS (SELECT 0 AS src, f.session_id AS id FROM folded f WHERE f.end_seq IS NOT NULL AND f.session_id IN (SELECT session_id FROM said WHERE contains(lower(message.content), 'block index'))),
a AS (SELECT DISTINCT 1 AS src, id FROM sessions WHERE id IN {_hits_sql('block index')})
SELECT id, CAST(min(src) AS INT) AS src FROM (FROM p UNION ALL FROM a) GROUP BY id""")
def stored_search_pending(spark, d):
    """Of an id that hits both in the log and in the archive, the one in the log."""
    a = _new(spark, d)
    a.append_events(_log(spark, d))
    return a.search("block index", mode="literal").select("id", F.col("src").cast("int").alias("src"))


# -- bulk ingest -----------------------------------------------------------------------------------

_KNOWN = "role IN ('user', 'system', 'model', 'assistant', 'thought', 'tool')"


@query(f"SELECT s.session_no, s.title, s.created_at, m.seq, {_ROLE} AS role, m.content, m.id, m.parent_id FROM sessions s JOIN messages m ON m.session_id = s.id WHERE m.{_KNOWN} AND m.content IS NOT NULL AND coalesce(s.created_at, 0) >= 0")
def bulk_sessions(spark, d):
    """Each session as one JSON document, read strictly on the executors, messages and all."""
    said = _messages(spark, d).where(f"{_KNOWN} and content is not null")
    one = F.struct("role", "content", "id", "parent_id", "tool_calls", F.col("seq").alias("n"))
    packed = said.groupBy(F.col("session_id").alias("id")).agg(F.collect_list(one).alias("messages"))
    rows = _sessions(spark, d).where("created_at is null or created_at >= 0").join(packed, "id")
    documents = rows.select("session_no", F.to_json(F.struct("id", "title", "source", "model", "created_at", "messages")).alias("json"))
    read = ingest.read_sessions(documents, "json")
    flat = read.select("session_no", "title", F.col("created_at").cast("long").alias("created_at"), F.explode("messages").alias("m"))
    return flat.select("session_no", "title", "created_at", F.get_json_object("m.metadata_json", "$.n").cast("int").alias("seq"), "m.role", "m.content", "m.id", "m.parent_id")


_LINES = _FOLD_SQL.replace("stream_events", "ev")


@query(f"""WITH ev AS (SELECT * FROM stream_events WHERE type <> 'message' OR (message.role IN ('user', 'system', 'model', 'assistant', 'thought', 'tool') AND message.content IS NOT NULL)), {_LINES}
SELECT f.session_id, count(s.event_no) AS messages, CAST(coalesce(sum(length(s.message.content)), 0) AS BIGINT) AS characters FROM folded f LEFT JOIN said s USING (session_id) WHERE f.end_seq IS NOT NULL GROUP BY f.session_id""")
def bulk_events(spark, d):
    """Events written as lines of JSON, with blank lines between them, read in bulk and folded."""
    log = _log(spark, d).where("type <> 'message' or (message.role in ('user', 'system', 'model', 'assistant', 'thought', 'tool') and message.content is not null)")
    head = F.to_json(F.struct("type", "session_id"))
    rest = F.when(F.length("metadata_json") > 2, F.concat(F.expr("left(h, length(h) - 1)"), F.lit(","), F.expr("substring(metadata_json, 2)"))).otherwise(F.col("h"))
    said = F.to_json(F.struct("type", "session_id", F.struct("message.role", "message.content", "message.id", "message.parent_id").alias("message")))
    lines = log.withColumn("h", head).select("seq", F.when(F.col("type") == "message", said).otherwise(rest).alias("value"))
    lines = lines.unionByName(lines.where("seq % 50 = 0").select("seq", F.lit("  ").alias("value")))
    path = scratch_path(spark, "lines")
    lines.orderBy("seq").select("value").write.text(path)
    read = ingest.read_events(spark, path)
    counts = events.pending_messages(read).groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(F.length("message.content")).alias("characters"))
    return events.folded(read).where("end_seq is not null").join(counts, "session_id", "left").select("session_id", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("characters", F.lit(0)).alias("characters"))


@query(f"""SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS INT) AS number, CASE role WHEN 'assistant' THEN 'model' WHEN 'model' THEN 'user' ELSE CASE WHEN {_KNOWN} AND role NOT IN ('model', 'thought') THEN role ELSE 'user' END END AS role, md5(content) AS digest
FROM messages WHERE coalesce(content, '') <> ''""")
def export_content(spark, d):
    """Sessions as tree exports: a chain of nodes with side branches, empty texts and unknown roles, the time a fraction."""
    m = _messages(spark, d).select("session_id", "seq", "role", "content")
    node = lambda name, up, words: F.struct(name.alias("id"), up.alias("parent"), F.struct(name.alias("id"), F.struct(F.coalesce("role", F.lit("nobody")).alias("role")).alias("author"), F.struct(F.lit("text").alias("content_type"), words.alias("parts")).alias("content")).alias("message"))
    own, up = F.concat(F.lit("n"), "seq"), F.when(F.col("seq") > 1, F.concat(F.lit("n"), F.col("seq") - 1))
    main = node(own, up, F.array(F.coalesce("content", F.lit(""))))
    side = node(F.concat(F.lit("side"), "seq"), own, F.array(F.lit("not on the way")))
    entries = m.select("session_id", "seq", F.explode(F.array(F.struct(own.alias("k"), main.alias("v")), F.struct(F.concat(F.lit("side"), "seq").alias("k"), side.alias("v")))).alias("e"))
    trees = entries.groupBy("session_id").agg(F.map_from_entries(F.collect_list("e")).alias("mapping"), F.concat(F.lit("n"), F.max("seq")).alias("current_node"))
    documents = trees.select("session_id", F.to_json(F.struct(F.col("session_id").alias("id"), "mapping", "current_node", F.lit(1700000000.75).alias("create_time"))).alias("json"))
    said = export_tree.export_sessions(documents, "json").where("created_at = 1700000000").select("session_id", F.posexplode("messages").alias("k", "m"))
    return said.select("session_id", (F.col("k") + 1).alias("number"), "m.role", F.md5("m.content").alias("digest"))
