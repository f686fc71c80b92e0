"""The tools of a document as a tool server: JSON-RPC 2.0 messages of the Model Context Protocol, one a line."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterable, Iterator

from .search import tools

VERSION = "2025-06-18"
# Names of tools there -> names in tools().
NAMES = {"semantic_search": "search", "get_domains": "list_domains", "get_tables": "list_tables", "table_detail": "get_table", "get_metrics": "list_metrics", "route_intent": "get_routing", "compile_metric": "compile_metric"}
ABOUT = {
    "semantic_search": "Tables, columns and metrics by keywords; start here.", "get_domains": "Groups of tables.", "get_tables": "Tables, of one domain if it is named.",
    "table_detail": "One table: columns, keys, relationships and the filters it requires.", "get_metrics": "All metrics.", "route_intent": "Tables to use, and to avoid, for a purpose.",
    "compile_metric": "SQL of a metric, or the reason of a refusal with what is allowed instead.", "join_path": "Tables on the way from one to another.",
}
GUIDE = "Search first and read a table before writing SQL. Apply required filters. Leave UNUSABLE objects alone, and say so where an answer rests on what was inferred."


class Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _schema(f: Callable) -> dict:
    given = inspect.signature(f).parameters
    return {"type": "object", "properties": {p: {"type": "string"} for p in given}, "required": [p for p, v in given.items() if v.default is v.empty]}


def _answer(known: dict[str, Callable], method: str, params: dict) -> dict:
    if method == "initialize":
        return {"protocolVersion": params.get("protocolVersion", VERSION), "capabilities": {"tools": {}}, "serverInfo": {"name": "quarrymill", "version": "1"}, "instructions": GUIDE}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [{"name": n, "description": ABOUT[n], "inputSchema": _schema(f)} for n, f in known.items()]}
    if method != "tools/call":
        raise Refused(-32601, f"unknown method {method!r}")
    f, arguments = known.get(params.get("name")), params.get("arguments") or {}
    if f is None:
        raise Refused(-32602, f"unknown tool {params.get('name')!r}")
    try:
        inspect.signature(f).bind(**arguments)
    except TypeError as e:
        raise Refused(-32602, str(e)) from e
    try:
        text, failed = json.dumps(f(**arguments), default=str), False
    except Exception as e:  # a tool that fails answers so; the server goes on
        text, failed = f"{type(e).__name__}: {e}", True
    return {"content": [{"type": "text", "text": text}], "isError": failed}


def serve(doc: dict, lines: Iterable[str]) -> Iterator[str]:
    """An answer for each line that asks for one; notifications get none, broken lines an error."""
    own = tools(doc)
    known = {n: own[k] for n, k in NAMES.items()} | {"join_path": own["join_path"]}
    for line in lines:
        if not line.strip():
            continue
        ident = None
        try:
            message = json.loads(line)
            if not isinstance(message, dict) or not isinstance(message.get("method"), str) or not isinstance(message.get("params") or {}, dict):
                raise Refused(-32600, "not a request")
            if "id" not in message:
                continue
            ident = message["id"]
            reply = {"result": _answer(known, message["method"], message.get("params") or {})}
        except json.JSONDecodeError as e:
            reply = {"error": {"code": -32700, "message": str(e)}}
        except Refused as e:
            reply = {"error": {"code": e.code, "message": str(e)}}
        yield json.dumps({"jsonrpc": "2.0", "id": ident} | reply)
