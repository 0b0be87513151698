"""Line-delimited JSON-RPC 2.0 server: add_log, search, read_session, get_recent_sessions, stats."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterable
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from convolith import __version__, commands
from convolith.archive import Archive, ArchiveError
from convolith.sources import ingest

PARSE, UNKNOWN, PARAMS, FAILED = -32700, -32601, -32602, 1
PROTOCOL = "2024-11-05"

_TEXT = {"type": "string"}
TOOLS = [
    {"name": "add_log", "description": "Store a session, an array of sessions or a tree export: as JSON, as JSON in a string, or by file path.", "inputSchema": {"type": "object", "properties": {"data": {"anyOf": [_TEXT, {"type": "object"}, {"type": "array"}]}, "is_file_path": {"type": "boolean"}}, "required": ["data"]}},
    {"name": "search", "description": "Sessions with a message that holds the text.", "inputSchema": {"type": "object", "properties": {"query": _TEXT}, "required": ["query"]}},
    {"name": "read_session", "description": "One session with all its messages.", "inputSchema": {"type": "object", "properties": {"id": _TEXT}, "required": ["id"]}},
    {"name": "get_recent_sessions", "description": "The last sessions, newest first.", "inputSchema": {"type": "object", "properties": {"count": {"type": "integer", "minimum": 1, "default": 10}}}},
    {"name": "stats", "description": "Counts, bytes and time range of the archive.", "inputSchema": {"type": "object"}},
]


class RpcError(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


class Server:
    def __init__(self, archive: Archive) -> None:
        self.archive = archive

    def _add(self, args: dict) -> str:
        data = args.get("data", args.get("input"))
        if data is None:
            raise RpcError(PARAMS, "missing argument: data")
        if args.get("is_file_path") is True:
            if not isinstance(data, str):
                raise RpcError(FAILED, "is_file_path needs a path in data")
            data = ingest.parse(Path(data).read_text(encoding="utf-8"))
        elif isinstance(data, str):
            data = ingest.parse(data)
        kind, n = commands.take_in(self.archive, data)
        if kind == "session":
            return "Session saved."
        return f"Imported {n}/{n} conversations of a tree export." if kind == "export" and n else f"Imported {n} sessions."

    def _search(self, args: dict) -> str:
        query = args.get("query") if isinstance(args.get("query"), str) else ""
        rows = self.archive.search(query).collect()
        return json.dumps([{"id": r["id"], "title": r["title"], "message_count": r["message_count"], "created_at": None if r["created_at"] is None else int(r["created_at"])} for r in rows], ensure_ascii=False)

    def _read(self, args: dict) -> str:
        row = self.archive.get(args.get("id") if isinstance(args.get("id"), str) else "").first()
        if row is None:
            raise RpcError(FAILED, "session not found")
        return json.dumps(commands.as_json(row), ensure_ascii=False)

    def _recent(self, args: dict) -> str:
        chosen = self.archive.recent(args.get("count"))
        full = {r["id"]: commands.as_json(r) for r in self.archive.nested(chosen).collect()}
        return json.dumps([full[r["id"]] for r in chosen.select("id").collect()], ensure_ascii=False)

    def _call(self, params: object) -> dict:
        if params is None:
            raise RpcError(PARAMS, "missing params")
        if not isinstance(params, dict) or not isinstance(params.get("name"), str):
            raise RpcError(PARAMS, "params need the name of a tool")
        args = params.get("arguments")
        args = args if isinstance(args, dict) else {}
        tools = {"add_log": self._add, "search": self._search, "read_session": self._read, "get_recent_sessions": self._recent, "stats": lambda _: json.dumps(self.archive.stats())}
        if params["name"] not in tools:
            raise RpcError(UNKNOWN, f"unknown tool: {params['name']}")
        try:
            text = tools[params["name"]](args)
        except (ValueError, ArchiveError, OSError) as e:
            raise RpcError(FAILED, str(e)) from e
        return {"content": [{"type": "text", "text": text}]}

    def answer(self, line: str) -> str | None:
        """The reply to one line; None for blank lines and for requests without an id."""
        if not line.strip():
            return None
        try:
            request = json.loads(line)
            if not isinstance(request, dict) or not isinstance(request.get("method"), str):
                raise ValueError("not a request")
        except ValueError as e:
            return json.dumps({"jsonrpc": "2.0", "error": {"code": PARSE, "message": f"parse error: {e}"}, "id": None})
        out: dict = {"jsonrpc": "2.0"}
        try:
            match request["method"]:
                case "initialize":
                    out["result"] = {"protocolVersion": PROTOCOL, "serverInfo": {"name": "convolith", "version": __version__}, "capabilities": {"tools": {}}}
                case "notifications/initialized":
                    pass
                case "ping":
                    out["result"] = {}
                case "tools/list":
                    out["result"] = {"tools": TOOLS}
                case "tools/call":
                    out["result"] = self._call(request.get("params"))
                case other:
                    raise RpcError(UNKNOWN, f"method not found: {other}")
        except RpcError as e:
            out["error"] = {"code": e.code, "message": str(e)}
        if request.get("id") is None:
            return None
        return json.dumps(out | {"id": request["id"]}, ensure_ascii=False)

    def serve(self, lines: Iterable[str], out: TextIO) -> None:
        for line in lines:
            reply = self.answer(line)
            if reply is not None:
                out.write(reply + "\n")
                out.flush()


def main() -> None:
    root = sys.argv[1] if len(sys.argv) > 1 else os.environ.get("CONVOLITH_DB", os.getcwd())
    spark = SparkSession.builder.appName("convolith-rpc").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    Server(Archive(spark, root)).serve(sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
