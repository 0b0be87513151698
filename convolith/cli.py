"""Command line: add, flush, search, stats, first, last, show, reindex, optimise."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from convolith import commands
from convolith.archive import Archive, ArchiveError, DataMissing
from convolith.functions.text import parse_when
from convolith.sources import ingest


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="convolith", description="Archive of chat conversations")
    p.add_argument("--db", default=os.environ.get("CONVOLITH_DB", "~/.convolith"), help="folder of the archive")
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser("add", help="a session, an array of sessions or a tree export; with --stream, events")
    add.add_argument("file", nargs="?", default="-")
    add.add_argument("--stream", action="store_true")
    sub.add_parser("flush", help="move finished sessions from the event log into the archive")
    search = sub.add_parser("search", help="literal text, any letter case")
    search.add_argument("query")
    search.add_argument("--after", help="date or unix seconds, inclusive")
    search.add_argument("--before", help="date or unix seconds, inclusive")
    search.add_argument("--json", action="store_true")
    search.add_argument("--mode", choices=("indexed", "literal"), default="indexed")
    sub.add_parser("stats")
    for name in ("first", "last"):
        sub.add_parser(name).add_argument("n", nargs="?", type=int, default=10)
    sub.add_parser("show").add_argument("id")
    sub.add_parser("reindex").add_argument("--yes", action="store_true")
    optimise = sub.add_parser("optimise")
    optimise.add_argument("--chunk-kb", type=int, default=256)
    optimise.add_argument("--yes", action="store_true")
    return p


def _agreed(question: str) -> bool:
    print(question)
    print("Go on [y/n]? ", end="", flush=True)
    if sys.stdin.readline().strip().lower() == "y":
        return True
    print("Nothing was changed.")
    return False


def _lines(file: str):
    if file == "-":
        yield from sys.stdin
    else:
        with open(file, encoding="utf-8") as f:
            yield from f


def _add(archive: Archive, file: str, stream: bool) -> None:
    if stream:
        events = list(ingest.events_of_lines(_lines(file)))
        archive.append_events(ingest.event_frame(archive.spark, events))
        n = archive.flush()
        if n:
            print(f"Archived {n} sessions.")
        return
    text = sys.stdin.read() if file == "-" else Path(file).read_text(encoding="utf-8")
    kind, n = commands.take_in(archive, ingest.parse(text))
    print({"session": "Session saved.", "export": f"Imported {n} conversations of a tree export.", "sessions": f"Imported {n} sessions."}[kind])


def _search(archive: Archive, args: argparse.Namespace) -> None:
    after, before = (None if t is None else parse_when(t) for t in (args.after, args.before))
    hits = archive.search(args.query, after, before, args.mode)
    if args.json:
        for row in archive.nested(hits).orderBy("src", "segment", "block_seq", "pos").toLocalIterator():
            print(json.dumps(commands.as_json(row), ensure_ascii=False))
        return
    any_ = False
    for row in hits.select("id", "title").toLocalIterator():
        any_ = True
        print(f"[{row['id']}] {row['title'] if row['title'] is not None else 'Untitled'}")
    if not any_:
        print("Nothing matches.")


def _stats(archive: Archive) -> None:
    s = archive.stats()
    print("The archive")
    print(f"Written to now:  {s['file_name']}")
    print(f"Sessions:        {s['session_count']}")
    print(f"Messages:        {s['message_count']}")
    print(f"On disk:         {s['total_size_bytes'] / 1024 / 1024:.2f} MB")
    if s["min_time"] > 0:
        print(f"From, to:        {commands.when(s['min_time'])}, {commands.when(s['max_time'])}")


def _show(archive: Archive, id: str) -> None:
    row = archive.get(id).first()
    if row is None:
        print(f"There is no session {id}")
        return
    print(f"Id: {row['id']}")
    print(f"Title: {row['title'] if row['title'] is not None else 'Untitled'}")
    for k in ("source", "model"):
        if row[k] is not None:
            print(f"{k.capitalize()}: {row[k]}")
    if row["created_at"] is not None:
        print(f"Created: {row['created_at']} ({commands.when(int(row['created_at']))})")
    print(f"\n{len(row['messages'])} messages\n")
    for k, m in enumerate(row["messages"]):
        print(f"[{k + 1}] {m['role']}\n{m['content']}\n")


def _list(archive: Archive, n: int, which: str) -> None:
    total = archive.scan().count()
    chosen = archive.first(max(0, n)) if which == "first" else archive.last(max(0, n))
    print(f"{which.capitalize()} {min(total, max(0, n))}, {total} in all\n")
    print("\n".join(commands.listing(archive, chosen)))


def _reindex(archive: Archive, yes: bool) -> None:
    if not yes and not _agreed("The index will be rebuilt from the data; no data is changed."):
        return
    try:
        n = archive.reindex()  # before the flush, which needs an index
    except DataMissing:
        n = 0
    fresh = archive.flush()
    print(f"Reindexed {n + fresh} sessions.")


def _optimise(archive: Archive, chunk_kb: int, yes: bool) -> None:
    if chunk_kb <= 0:
        raise ArchiveError("--chunk-kb must be greater than 0")
    if not yes and not _agreed(f"Data and index will be rewritten in blocks of about {chunk_kb} KB."):
        return
    archive.flush()
    blocks, sessions = archive.optimise(chunk_kb * 1024)
    print(f"Optimised {sessions} sessions into {blocks} blocks (about {chunk_kb} KB each).")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("convolith").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    archive = Archive(spark, args.db)
    try:
        match args.command:
            case "add":
                _add(archive, args.file, args.stream)
            case "flush":
                print(f"Flushed {archive.flush()} sessions to the archive.")
            case "search":
                _search(archive, args)
            case "stats":
                _stats(archive)
            case "first" | "last":
                _list(archive, args.n, args.command)
            case "show":
                _show(archive, args.id)
            case "reindex":
                _reindex(archive, args.yes)
            case "optimise":
                _optimise(archive, args.chunk_kb, args.yes)
    except (ValueError, ArchiveError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
