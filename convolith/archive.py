"""A versioned archive of conversations on any file system Spark can write to.

Data, index and event log are Parquet folders that are never changed once written.  A manifest names
the folders that make up the present state; every change writes new folders, then replaces the
manifest in one rename.  Readers work on the manifest they read and take no lock.
"""

from __future__ import annotations

import fcntl
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolith.functions.metadata import sink
from convolith.operators import blocks, browse, events, search, stats
from convolith.schema import ARCHIVE_MESSAGES, ARCHIVE_SESSIONS, BLOCK_INDEX, EVENT, MESSAGE, TOKEN_INDEX
from convolith.shared import materialise, passing, ship_package

FORMAT = 1
WAL_LIMIT = 256 * 1024
LOCK_SECONDS, LOCK_POLL = 5.0, 0.05
PLACE = ["segment", "block_seq", "pos"]
LISTED = 1000  # most blocks that are named to a scan instead of joined
SPREAD = 5000  # messages of a session that one task writes


class ArchiveError(RuntimeError):
    pass


class IndexMissing(ArchiveError):
    pass


class DataMissing(ArchiveError):
    pass


class LockTimeout(ArchiveError):
    pass


class Archive:
    def __init__(self, spark: SparkSession, root: str, segment_bytes: int = blocks.SEGMENT_BYTES) -> None:
        ship_package(spark)
        self.spark, self.segment_bytes = spark, segment_bytes
        self.root = (root if "://" in root else "file://" + os.path.abspath(os.path.expanduser(root))).rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- files ---------------------------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _bytes(self, name: str) -> int:
        p = self._path(name)
        return int(self._fs.getContentSummary(p).getLength()) if self._fs.exists(p) else 0

    def _write_text(self, name: str, text: str) -> None:
        temp = self._path(f".{name}-{uuid.uuid4().hex}")
        out = self._fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.root.startswith("file:"):
            os.replace(temp.toUri().getPath(), self._path(name).toUri().getPath())
        else:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri())
            options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            context.rename(temp, self._path(name), options)

    def manifest(self) -> dict:
        p = self._path("manifest.json")
        if not self._fs.exists(p):
            return {"format": FORMAT, "version": 0, "segments": {}, "wal": [], "next_seq": 0, "rejects": []}
        stream = self._fs.open(p)
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            m = json.loads(text)
        except json.JSONDecodeError:
            raise ArchiveError("Invalid file format: the manifest can't be read") from None
        if not isinstance(m, dict) or m.get("format") != FORMAT:
            raise ArchiveError("Invalid file format: the manifest is of another version")
        return m

    def _commit(self, m: dict) -> None:
        self._write_text("manifest.json", json.dumps(m | {"version": m["version"] + 1}, indent=1))

    @contextmanager
    def lock(self, seconds: float = LOCK_SECONDS) -> Iterator[None]:
        """Exclusive among writers; polls until the time is over.  The folder is made if need be."""
        self._fs.mkdirs(self._path(""))
        until = time.monotonic() + seconds
        if self.root.startswith("file:"):
            with Path(self._path("lock").toUri().getPath()).open("a") as f:
                while True:
                    try:
                        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                        break
                    except BlockingIOError:
                        if time.monotonic() >= until:
                            raise LockTimeout("the archive is locked by another process") from None
                        time.sleep(LOCK_POLL)
                yield
            return
        name = self._path("lock")
        while not self._fs.createNewFile(name):
            if time.monotonic() >= until:
                raise LockTimeout("the archive is locked by another process")
            time.sleep(LOCK_POLL)
        try:
            yield
        finally:
            self._fs.delete(name, False)

    # -- reading -------------------------------------------------------------------------------

    def _read(self, m: dict, kind: str, schema, sub: str, only: list[str] | None = None) -> DataFrame:
        names = [f"{self.root}/{g}/{sub}/seg={n}" for n, s in sorted(m["segments"].items(), key=lambda x: int(x[0])) if only is None or n in only for g in s.get(kind) or []]
        names = [n for n in names if self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(n))]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def sessions(self, m: dict | None = None) -> DataFrame:
        return self._read(m or self.manifest(), "data", ARCHIVE_SESSIONS, "sessions")

    def messages(self, m: dict | None = None) -> DataFrame:
        return self._read(m or self.manifest(), "data", ARCHIVE_MESSAGES, "messages")

    def block_index(self, m: dict | None = None) -> DataFrame:
        return self._read(m or self.manifest(), "index", BLOCK_INDEX, "blocks")

    def token_index(self, m: dict | None = None) -> DataFrame:
        return self._read(m or self.manifest(), "index", TOKEN_INDEX, "tokens")

    def events(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest()
        return self.spark.read.schema(EVENT).parquet(*[f"{self.root}/{w}" for w in m["wal"]]) if m["wal"] else self.spark.createDataFrame([], EVENT)

    def segments(self) -> list[int]:
        return sorted(map(int, self.manifest()["segments"]))

    def active_segment(self, m: dict | None = None) -> int:
        return max(map(int, (m or self.manifest())["segments"]), default=1)

    def block_count(self) -> int:
        """Without reading any data."""
        m = self.manifest()
        if not m["segments"]:
            raise DataMissing("there is no data")
        return sum(s["blocks"] for s in m["segments"].values())

    def _need_index(self, m: dict) -> None:
        for n, s in m["segments"].items():
            if s.get("index") is None:
                raise IndexMissing(f"segment {n} has no index; run reindex")

    # -- writing -------------------------------------------------------------------------------

    def _write_blocks(self, m: dict, sessions: DataFrame, messages: DataFrame, per_block: int | None, in_files: bool = False) -> int:
        """Write sessions (ord and their fields) and messages (ord, seq and theirs) as blocks; they are in ``m`` afterwards.

        Neither is ever gathered: sessions get their place, messages take it over by ``ord``.  Messages are
        read twice; those that are ``in_files`` already are not written for it.
        """
        with passing(self.spark):
            return self._place_blocks(m, sessions, messages if in_files else materialise(messages, "messages"), per_block)

    def _place_blocks(self, m: dict, sessions: DataFrame, said: DataFrame, per_block: int | None) -> int:
        held = said.groupBy("ord").agg(F.count("*").alias("message_count"), F.sum(F.octet_length(F.to_json(F.struct(*MESSAGE.fieldNames())))).alias("bytes"))
        rows = materialise(sessions.join(held, "ord", "left").na.fill(0, ["message_count", "bytes"]), "sessions")
        count = rows.count()
        if not count:
            return 0
        active = self.active_segment(m)
        old = m["segments"].get(str(active), {})
        placed = blocks.bulk_blocks(rows, ["ord"], per_block or count)
        # one unit of size for what is there and what is added: the bytes of the messages as JSON
        summary = placed.groupBy("block_no").agg(F.sum("bytes").alias("bytes"))
        at = blocks.segments(summary, ["block_no"], F.col("bytes"), self.segment_bytes, old.get("raw", 0), active).select("block_no", F.col("bytes").alias("_raw"), F.col("segment_no").cast("int").alias("segment"))
        at = materialise(at, "segments")
        # numbers of blocks go on in the active segment, and start anew in each new one
        begins = at.groupBy("segment").agg(F.min("block_no").alias("_begin"), F.sum("_raw").alias("raw"), F.count("*").alias("blocks"))
        kept = F.when(F.col("segment") == active, F.lit(old.get("next_block", 0))).otherwise(0)
        at = at.join(begins.select("segment", "_begin"), "segment").select("block_no", "segment", (F.col("block_no") - F.col("_begin") + kept).cast("long").alias("block_seq"))
        gen = f"data/{uuid.uuid4().hex}"
        placed = materialise(placed.join(at, "block_no"), "placed")
        out = placed.select(*PLACE, "id", "title", "source", "model", F.col("created_at").cast("decimal(20,0)").alias("created_at"), "metadata_json", "message_count")
        self._store(out, f"{gen}/sessions")
        self._store(said.withColumn("seq", F.col("seq").cast("long")).join(placed.select("ord", *PLACE), "ord").select(*ARCHIVE_MESSAGES.fieldNames()), f"{gen}/messages", spread="seq")
        for r in begins.collect():  # a row for each segment
            n = str(r["segment"])
            s = m["segments"].setdefault(n, {"data": [], "index": [], "bytes": 0, "raw": 0, "blocks": 0, "next_block": 0})
            s["data"].append(gen)
            s["blocks"] += r["blocks"]
            s["next_block"] += r["blocks"]
            s["raw"] = s.get("raw", 0) + int(r["raw"])
            s["bytes"] += self._bytes(f"{gen}/sessions/seg={n}") + self._bytes(f"{gen}/messages/seg={n}")
            if s.get("index") is not None:
                s["index"].append(self._write_index({"segments": {n: {"data": [gen]}}}))
        return count

    def _store(self, df: DataFrame, name: str, order: tuple[str, ...] = ("block_seq",), level: int | None = None, spread: str | None = None) -> None:
        """Files clustered by segment and ``order``; a long run of ``spread`` numbers is shared by several tasks."""
        keys = [F.col("seg"), *map(F.col, order), *([F.floor(F.col(spread) / SPREAD)] if spread else [])]
        inside = [*order, *[c for c in ("pos", "seq") if c in df.columns]]
        out = df.withColumn("seg", F.col("segment")).repartition(*keys).sortWithinPartitions("seg", *inside).write.mode("error").partitionBy("seg").option("compression", "zstd")
        if level is not None:
            out = out.option("parquet.compression.codec.zstd.level", level)
        out.parquet(f"{self.root}/{name}")

    def _write_index(self, m: dict) -> str:
        gen = f"index/{uuid.uuid4().hex}"
        sessions, messages = self._read(m, "data", ARCHIVE_SESSIONS, "sessions"), self._read(m, "data", ARCHIVE_MESSAGES, "messages")
        keyed = sessions.withColumn("_place", F.struct(*PLACE))
        said = messages.select(F.struct(*PLACE).alias("_place"), "content")
        size = sum(self._bytes(f"{g}/messages/seg={n}") for n, s in m["segments"].items() for g in s["data"])
        raw = max(1, said.agg(F.sum(F.octet_length("content"))).first()[0] or 1)
        index = search.block_index(keyed, said, "_place", "_place").withColumn("compressed_bytes", F.least(F.col("uncompressed_bytes"), F.ceil(F.col("uncompressed_bytes") * (size / raw))))
        self._store(index.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in BLOCK_INDEX.fields]), f"{gen}/blocks")
        self._store(search.stored_token_index(sessions, messages).select(*TOKEN_INDEX.fieldNames()), f"{gen}/tokens", ("token",))
        return gen

    @staticmethod
    def _flat(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sessions and messages of rows that hold their messages as an array."""
        said = rows.select("ord", F.posexplode("messages").alias("seq", "m")).select("ord", (F.col("seq") + 1).alias("seq"), "m.*")
        return rows.drop("messages"), said

    def append_session(self, rows: DataFrame) -> int:
        with self.lock():
            m = self.manifest()
            n = self._write_blocks(m, *self._flat(rows), None)
            self._commit(m)
            return n

    def append_bulk(self, rows: DataFrame) -> int:
        """Sessions in blocks of a hundred, past the event log; ids are not checked."""
        return self.append_tables(*self._flat(rows))

    def append_tables(self, sessions: DataFrame, messages: DataFrame) -> int:
        """The same from two tables: sessions with ``ord``, a number, and messages with the ord of theirs and seq."""
        with self.lock():
            m = self.manifest()
            n = self._write_blocks(m, sessions, messages, blocks.BULK)
            self._commit(m)
            return n

    def _append_events(self, m: dict, rows: DataFrame) -> None:
        name = f"wal/{uuid.uuid4().hex}"
        rows = rows.withColumn("seq", F.col("seq") + m["next_seq"])
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        last = self.spark.read.schema(EVENT).parquet(f"{self.root}/{name}").agg(F.max("seq")).first()[0]
        if last is not None:
            m["wal"].append(name)
            m["next_seq"] = last + 1

    def append_events(self, rows: DataFrame) -> None:
        with self.lock():
            m = self.manifest()
            self._append_events(m, rows)
            self._commit(m)

    def append_pending(self, rows: DataFrame) -> int:
        """Sessions as start, messages and finalize in the event log; flushed if that grows too large."""
        own = {k: F.col(k) for k in ("title", "source", "model", "created_at")}
        none = F.lit(None).cast(EVENT["message"].dataType)
        start = F.struct(F.lit("session_start").alias("type"), F.col("id").alias("session_id"), none.alias("message"), sink(F.when(F.col("metadata_json") != "", F.col("metadata_json")), own).alias("metadata_json"))
        end = F.struct(F.lit("finalize").alias("type"), F.col("id").alias("session_id"), none.alias("message"), F.lit(None).cast("string").alias("metadata_json"))
        each = F.transform("messages", lambda x: F.struct(F.lit("message").alias("type"), F.col("id").alias("session_id"), x.alias("message"), F.lit(None).cast("string").alias("metadata_json")))
        flat = rows.select("ord", F.posexplode(F.concat(F.array(start), each, F.array(end))).alias("k", "e"))
        events_ = blocks.ranked(flat, ["ord", "k"]).select((F.col("rn") - 1).alias("seq"), "e.*")
        with self.lock():
            m = self.manifest()
            self._append_events(m, events_)
            self._commit(m)
            if sum(map(self._bytes, m["wal"])) > WAL_LIMIT:
                return self._flush()
        return 0

    def flush(self) -> int:
        with self.lock():
            return self._flush()

    def _flush(self) -> int:
        """Archive finished sessions that aren't archived yet as one block, many as several; the rest stays in the log."""
        m = self.manifest()
        log = self.events(m)
        with passing(self.spark):
            archived = self.sessions(m).select(F.col("id").alias("session_id"), F.lit(True).alias("known")).distinct()
            finished = materialise(events.folded(log).where("end_seq is not null").join(archived, "session_id", "left"), "folded")
            if finished.isEmpty():
                return 0
            self._need_index(m)
            fresh = events.as_sessions(finished.where("known is null"))
            # several finalizes may share a place only if sequence numbers do; the id settles it
            order = blocks.ranked(fresh, ["end_seq", "id"]).withColumnRenamed("rn", "ord")
            rows = materialise(order.select("ord", "id", "title", "source", "model", "created_at", "metadata_json", "start_seq"), "finished")
            known = finished.where("known").select("session_id", "start_seq", F.lit(None).cast("long").alias("ord"))
            # the log is joined once and parted by what becomes of each event; the rest of a session now archived goes
            begun = rows.select(F.col("id").alias("session_id"), "start_seq", "ord").unionByName(known)
            fate = F.when(F.col("start_seq").isNull(), "rest").when(F.col("ord").isNull(), "rejected").when((F.col("type") == "message") & (F.col("seq") > F.col("start_seq")), "said")
            parted = materialise(log.join(begun, "session_id", "left").withColumn("fate", fate).where("fate is not null").select(*log.columns, "ord", "fate"), "parted", ("fate",))
            rejects = parted.where("fate = 'rejected'").select(*log.columns)
            if not rejects.isEmpty():
                name = f"rejects/{uuid.uuid4().hex}"
                rejects.write.parquet(f"{self.root}/{name}")
                m["rejects"].append(name)
            said = parted.where("fate = 'said'").select("ord", "seq", "message.*")
            count = self._write_blocks(m, rows.drop("start_seq"), said, blocks.FLUSH, in_files=True)
            name = f"wal/{uuid.uuid4().hex}"
            parted.where("fate = 'rest'").select(*log.columns).write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        m["wal"] = [name] if not self.spark.read.schema(EVENT).parquet(f"{self.root}/{name}").isEmpty() else []
        self._commit(m)
        return count

    # -- queries -------------------------------------------------------------------------------

    def _pending(self, m: dict) -> DataFrame:
        log = self.events(m)
        counts = events.pending_messages(log).groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("message_count"))
        return events.pending_sessions(log).join(counts, "id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))

    _FIELDS = ("id", "title", "source", "model", "created_at", "metadata_json", "message_count")

    def _both(self, m: dict, archived: DataFrame, pending: DataFrame) -> DataFrame:
        """Archive and pending sessions with src (0 pending, 1 archive) and the order of each."""
        order = ("segment", "block_seq", "pos")
        a = archived.select(F.lit(1).alias("src"), *[F.col(c).cast("long").alias(c) for c in order], *self._FIELDS)
        p = pending.select(F.lit(0).alias("src"), F.lit(2**31).cast("long").alias("segment"), F.col("end_seq").alias("block_seq"), F.lit(0).cast("long").alias("pos"), *self._FIELDS)
        return a.unionByName(p)

    def scan(self) -> DataFrame:
        """All sessions in insertion order: archive, then pending; of an id the archived, earliest one."""
        m = self.manifest()
        both = self._both(m, self.sessions(m), self._pending(m))
        return browse.first_wins(both, "id", F.desc("src"), *PLACE)

    def _within(self, m: dict, places: DataFrame, kinds: tuple[str, ...]) -> list[DataFrame]:
        """The tables of ``kinds`` cut to the blocks of ``places`` (segment, block_seq), one row each.

        A few blocks become a list: only the folders of their segments are read, and the numbers of blocks,
        by which files are clustered, reach the scan as a filter.  Many are joined.
        """
        found = places.limit(LISTED + 1).collect()
        schemas = {"sessions": ARCHIVE_SESSIONS, "messages": ARCHIVE_MESSAGES}
        if len(found) > LISTED:
            return [self._read(m, "data", schemas[k], k).join(places, ["segment", "block_seq"], "left_semi") for k in kinds]
        by: dict[int, list[int]] = {}
        for r in found:
            by.setdefault(r["segment"], []).append(r["block_seq"])
        inside = F.lit(False)
        for n, numbers in by.items():
            inside = inside | ((F.col("segment") == n) & F.col("block_seq").isin(numbers))
        only = [str(n) for n in by]
        every = sorted({b for numbers in by.values() for b in numbers})
        return [self._read(m, "data", schemas[k], k, only).where(F.col("block_seq").isin(every) & inside) for k in kinds]

    def search(self, query: str, after: int | None = None, before: int | None = None, mode: str = "indexed") -> DataFrame:
        """Matching sessions, pending ones first.  Mode ``literal`` doesn't let the index gate words."""
        m = self.manifest()
        if mode == "indexed":
            self._need_index(m)
            # every segment has its index here, so what survives is all that has to be read
            places = search.surviving_blocks(self.block_index(m), self.token_index(m), query, after, before).distinct()
            sessions, messages = self._within(m, places, ("sessions", "messages"))
        else:
            sessions, messages = self.sessions(m), self.messages(m)
        hits = search.matching(sessions.withColumn("_place", F.struct(*PLACE)), messages.select(F.struct(*PLACE).alias("_place"), "content"), "_place", "_place", query, after, before)
        log = self.events(m)
        waiting = search.matching(self._pending(m), events.pending_messages(log).select("session_id", F.col("message.content").alias("content")), "id", "session_id", query, after, before)
        both = browse.first_wins(self._both(m, hits, waiting), "id", "src", *PLACE)
        return both.orderBy("src", *PLACE)

    def nested(self, chosen: DataFrame, messages: DataFrame | None = None) -> DataFrame:
        """Chosen sessions with their messages as one array each, for output."""
        m = self.manifest()
        said = (self.messages(m) if messages is None else messages).select(F.lit(1).alias("src"), *[F.col(c).cast("long").alias(c) for c in PLACE], "seq", F.struct(*EVENT["message"].dataType.fieldNames()).alias("message"))
        waiting = events.pending_messages(self.events(m)).select("session_id", "seq", "message")
        a = chosen.where("src = 1").join(said, ["src", *PLACE]).select("id", "seq", "message")
        p = waiting.join(chosen.where("src = 0").select(F.col("id").alias("session_id")), "session_id").select(F.col("session_id").alias("id"), "seq", "message")
        arrays = a.unionByName(p).groupBy(F.col("id").alias("_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda x: x["message"]).alias("messages"))
        out = chosen.join(arrays, chosen["id"] == arrays["_id"], "left")
        return out.select(*chosen.columns, F.coalesce("messages", F.array().cast("array<" + EVENT["message"].dataType.simpleString() + ">")).alias("messages"))

    def get(self, id: str) -> DataFrame:
        """The session of an id: pending before archive, then the earliest; no row if there is none."""
        m = self.manifest()
        self._need_index(m)
        where = self.block_index(m).where(F.array_contains("session_ids", id)).select("segment", "block_seq").distinct()
        sessions, messages = self._within(m, where, ("sessions", "messages"))
        waiting = self._pending(m).where(F.col("id") == id)
        return self.nested(self._both(m, sessions.where(F.col("id") == id), waiting).orderBy("src", *PLACE).limit(1), messages)

    def first(self, n: int = 10) -> DataFrame:
        return browse.first_n(self.scan(), ["segment", "block_seq", "pos"], n)

    def last(self, n: int = 10) -> DataFrame:
        return browse.last_n(self.scan(), ["segment", "block_seq", "pos"], n)

    def recent(self, n: object = 10) -> DataFrame:
        return browse.recent_n(self.scan(), ["segment", "block_seq", "pos"], n)

    def stats(self) -> dict:
        """Counts, bytes and times; of segments without an index from their rows."""
        m = self.manifest()
        indexed = [n for n, s in m["segments"].items() if s.get("index") is not None]
        bare = [n for n in m["segments"] if n not in indexed]
        columns = ("session_count", "message_count", "min_time", "max_time")
        index = self._read(m, "index", BLOCK_INDEX, "blocks", indexed)
        parts = [stats.from_index(index).select(*columns)]
        if bare:
            parts.append(stats.from_scan(self._read(m, "data", ARCHIVE_SESSIONS, "sessions", bare), self._read(m, "data", ARCHIVE_MESSAGES, "messages", bare)).select(*columns))
        waiting = self._pending(m)
        parts.append(stats.from_scan(waiting, events.pending_messages(self.events(m))).select(*columns))
        total = parts[0]
        for p in parts[1:]:
            total = stats.with_pending(total, p)
        row = total.first()
        size = index.agg(F.sum("compressed_bytes").alias("c"), F.sum("uncompressed_bytes").alias("u")).first()
        disk = sum(map(self._bytes, m["wal"])) + sum(self._bytes(f"{g}/{sub}/seg={n}") for n, s in m["segments"].items() for g in s["data"] for sub in ("sessions", "messages"))
        return {"file_name": f"segment {self.active_segment(m)}", "session_count": int(row["session_count"]), "message_count": int(row["message_count"]), "total_size_bytes": disk, "data_compressed_bytes": int(size["c"] or 0), "data_uncompressed_bytes": int(size["u"] or 0), "min_time": int(row["min_time"]), "max_time": int(row["max_time"])}

    # -- maintenance ---------------------------------------------------------------------------

    def drop_index(self) -> None:
        with self.lock():
            m = self.manifest()
            for s in m["segments"].values():
                s["index"] = None
            self._commit(m)

    def reindex(self, progress: Callable[[int], None] | None = None) -> int:
        """Rebuild the index of every segment from its rows; the number of sessions."""
        with self.lock():
            m = self.manifest()
            if not m["segments"]:
                raise DataMissing("there is no data to index")
            gen = self._write_index(m)
            for s in m["segments"].values():
                s["index"] = [gen]
            self._commit(m)
            n = self.sessions(m).count()
            if progress:
                progress(n)
            return n

    def optimise(self, target_bytes: int, progress: Callable[[int], None] | None = None) -> tuple[int, int]:
        """Repack the active segment into blocks of about ``target_bytes`` compressed; (blocks, sessions)."""
        with self.lock():
            m = self.manifest()
            if not m["segments"]:
                return 0, 0
            active = str(self.active_segment(m))
            only = {"segments": {active: m["segments"][active]}}
            sessions, messages = self._read(only, "data", ARCHIVE_SESSIONS, "sessions"), self._read(only, "data", ARCHIVE_MESSAGES, "messages")
            text = messages.groupBy(*PLACE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), " ").alias("text"))
            packed = blocks.greedy_blocks(sessions.select(*PLACE).join(text, PLACE, "left"), "segment", ["block_seq", "pos"], "text", target_bytes)
            order = packed.withColumn("new_pos", F.col("pos"))
            moved = blocks.ranked(order, ["segment", "block_seq", "pos"]).withColumn("start", F.col("rn"))
            first = moved.groupBy("block_no").agg(F.min("rn").alias("first"))
            new = moved.join(first, "block_no").select(*PLACE, F.col("block_no").alias("new_block"), (F.col("rn") - F.col("first")).cast("int").alias("new_at")).persist()
            put: dict[str, Column] = {"block_seq": F.col("new_block"), "pos": F.col("new_at")}
            gen = f"data/{uuid.uuid4().hex}"
            self._store(sessions.join(new, PLACE).withColumns(put).select(*ARCHIVE_SESSIONS.fieldNames()), f"{gen}/sessions", level=19)
            self._store(messages.join(new, PLACE).withColumns(put).select(*ARCHIVE_MESSAGES.fieldNames()), f"{gen}/messages", level=19, spread="seq")
            done = new.agg(F.countDistinct("new_block").alias("b"), F.count("*").alias("n")).first()
            new.unpersist()
            s = {"data": [gen], "index": [], "blocks": done["b"], "next_block": done["b"], "raw": m["segments"][active].get("raw", 0), "bytes": self._bytes(f"{gen}/sessions/seg={active}") + self._bytes(f"{gen}/messages/seg={active}")}
            s["index"] = [self._write_index({"segments": {active: s}})]
            m["segments"][active] = s
            self._commit(m)
            if progress:
                progress(done["n"])
            return done["b"], done["n"]
