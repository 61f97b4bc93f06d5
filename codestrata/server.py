"""JSON-RPC over lines: initialize, tools/list, tools/call, ping, shutdown."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from pyspark.sql import DataFrame

from .engine import TOOLS, Engine, input_schema

VERSION = "2024-11-05"


def plain(value):
    """A result as JSON values. A table's rows are fetched a partition at a time; columns marked as JSON are nested, not quoted."""
    if not isinstance(value, DataFrame):
        return value
    nested = [f.name for f in value.schema if f.metadata.get("json")]
    rows = [json.loads(x) for x in value.toJSON().toLocalIterator()]
    return [row | {c: json.loads(row[c]) for c in nested if row.get(c)} for row in rows]


def handle(engine: Engine, line: str) -> dict | None:
    """The response to one request line; None for notifications."""

    def error(number, code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}}

    try:
        request = json.loads(line)
    except ValueError:
        return error(None, -32700, "Parse error")
    if not isinstance(request, dict) or not isinstance(request.get("method"), str):
        return error(request.get("id") if isinstance(request, dict) else None, -32600, "Invalid request")
    number, method, params = request.get("id"), request["method"], request.get("params") or {}
    if method in ("notifications/initialized", "initialized", "notifications/cancelled"):
        return None
    if method == "initialize":
        result = {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "codestrata", "version": "0.1"}}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": t["description"], "inputSchema": input_schema(n)} for n, t in TOOLS.items()]}
    elif method in ("ping", "shutdown"):
        result = {}
    elif method == "tools/call":
        if params.get("name") not in TOOLS:
            return error(number, -32602, f"Unknown tool: {params.get('name')}")
        try:
            body, failed = json.dumps(plain(engine.call(params["name"], **(params.get("arguments") or {}))), indent=2, ensure_ascii=False, default=str), False
        except Exception as problem:  # noqa: BLE001
            body, failed = str(problem)[:4000], True
        result = {"content": [{"type": "text", "text": body}], "isError": failed}
    else:
        return error(number, -32601, f"Method not found: {method}")
    return {"jsonrpc": "2.0", "id": number, "result": result}


def serve(engine: Engine, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """Answer request lines until the end of input or shutdown. Blank lines are skipped."""
    for line in source:
        if not line.strip():
            continue
        response = handle(engine, line)
        if response is not None:
            sink.write(json.dumps(response, ensure_ascii=False) + "\n")
            sink.flush()
        if '"shutdown"' in line and response and "result" in response:
            return
