"""The questions of the command line as tools of a JSON-RPC server over standard input and output, one message a line:
``python -m navgraph.server --root TREE --store FACTS [--custom FOLDER]``.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable
from itertools import islice
from typing import TextIO

from navgraph.cli import COMMANDS, run
from navgraph.session import session

PROTOCOL = "2024-11-05"
#: Rows of an answer that a message carries; ``more`` tells of others.
MOST_ITEMS = 200
KINDS = {str: "string", int: "integer", bool: "boolean"}
Caller = Callable[[str, dict], dict]


def field(flag: str) -> str:
    return flag.lstrip("-").replace("-", "_")


def tools() -> list[dict]:
    """Name and input schema of every command."""
    found = []
    for name, arguments in COMMANDS.items():
        many = lambda flag, name=name: name == "blast-radius" and flag == "files"
        schema = {field(flag): {"type": "array", "items": {"type": "string"}} if many(flag) else {"type": KINDS[kind]} for flag, kind, _ in arguments}
        needed = [field(flag) for flag, _, default in arguments if default is ... and not many(flag)]
        found.append({"name": name, "inputSchema": {"type": "object", "properties": schema, "required": needed}})
    return found


def handle(message: dict, call: Caller) -> dict | None:
    """The reply to one message; None for a notification. A tool that fails gives a result marked ``isError``."""
    reply = {"jsonrpc": "2.0", "id": message.get("id")}
    params = message.get("params") or {}
    match message.get("method"):
        case "initialize":
            return reply | {"result": {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "navgraph", "version": "1"}}}
        case "ping":
            return reply | {"result": {}}
        case "tools/list":
            return reply | {"result": {"tools": tools()}}
        case "tools/call":
            try:
                told, failed = call(params["name"], params.get("arguments") or {}), False
            except Exception as error:  # noqa: BLE001  the caller is told, the server goes on
                told, failed = {"error": f"{type(error).__name__}: {error}"}, True
            return reply | {"result": {"content": [{"type": "text", "text": json.dumps(told, default=str, ensure_ascii=False)}], "isError": failed}}
        case _:
            return None if "id" not in message else reply | {"error": {"code": -32601, "message": f"unknown method {message.get('method')!r}"}}


def caller(spark, root: str, store: str, custom: str | None) -> Caller:
    """Runs a command with its defaults and the arguments given."""

    def call(name: str, given: dict) -> dict:
        values = {field(flag): None if default is ... else default for flag, _, default in COMMANDS[name]}
        missing = [k for k, v in values.items() if v is None and k in next(t for t in tools() if t["name"] == name)["inputSchema"]["required"] and k not in given]
        unknown = sorted(set(given) - set(values) - {"refresh", "targets"})
        if missing or unknown:
            raise ValueError(f"missing: {missing}, unknown: {unknown}")
        if name == "blast-radius":
            values["files"] = []
        told = run(argparse.Namespace(**({"command": name, "root": root, "store": store, "custom": custom, "targets": [], "refresh": "auto"} | values | given)), spark)
        if isinstance(told, dict):
            return told
        rows = [r.asDict(recursive=True) for r in islice(told.rows.toLocalIterator(), MOST_ITEMS + 1)]
        about = {"query": told.query, "coverage": told.coverage, "index": told.index, "note": told.note, "counts": told.counts()}
        return about | {"items": rows[:MOST_ITEMS], "more": len(rows) > MOST_ITEMS}

    return call


def serve(lines: Iterable[str], out: TextIO, call: Caller) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = handle(json.loads(line), call)
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="navgraph-server")
    parser.add_argument("--root", required=True)
    parser.add_argument("--store", required=True)
    parser.add_argument("--custom")
    args = parser.parse_args(argv)
    serve(sys.stdin, sys.stdout, caller(session(), args.root, args.store, args.custom))
    return 0


if __name__ == "__main__":
    sys.exit(main())
