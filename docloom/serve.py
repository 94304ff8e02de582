"""A tool server: JSON-RPC requests, one a line, on stdin; answers on stdout."""

from __future__ import annotations

import json
import sys
from typing import IO, Any

from .plans.engine import Engine
from .surface import mode_of, tool_text

TOOL = {
    "name": "Execute",
    "description": "Search the indexed documents",
    "inputSchema": {
        "type": "object",
        "properties": {
            "query": {"type": "string"},
            "maxResults": {"type": "integer", "default": 5},
            "sourceIds": {"type": "array", "items": {"type": "string"}},
            "searchMode": {"type": "string", "default": "bm25"},
        },
        "required": ["query"],
    },
}


class Refused(Exception):
    """A request that can't be answered, with the code that says why."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Server:
    def __init__(self, engine: Engine):
        if not engine.exists():
            raise NotADirectoryError(f"Index directory not found: {engine.path}")
        self.engine = engine

    def execute(self, query: str | None = None, maxResults: int = 5, sourceIds: list[str] | None = None, searchMode: str = "bm25") -> dict[str, str]:
        if not query:
            return {"error": "Query is required"}
        if not isinstance(query, str) or not isinstance(searchMode, str) or type(maxResults) is not int or not isinstance(sourceIds, list | None) or not all(isinstance(x, str) for x in sourceIds or []):
            return {"error": "query and searchMode are strings, maxResults an integer, sourceIds strings"}
        if not self.engine.exists():
            return {"error": f"Index directory not found: {self.engine.path}"}
        try:
            rows = self.engine.search(query, mode_of(searchMode, strict=False), maxResults, sourceIds).collect()
            return {"content": tool_text(rows, searchMode)}
        except Exception as e:  # noqa: BLE001 - a failed call is an answer, not the end
            return {"error": str(e)}

    def answer(self, request: dict[str, Any]) -> Any:
        method, params = request.get("method"), request.get("params")
        if not isinstance(method, str):
            raise Refused(-32600, "method must be a string")
        if not isinstance(params, dict | None):
            raise Refused(-32602, "params must be an object")
        params = params or {}
        if method == "initialize":
            return {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "docloom", "version": "1"}}
        if method == "tools/list":
            return {"tools": [TOOL]}
        if method == "tools/call":
            name, given = params.get("name"), params.get("arguments")
            if not isinstance(name, str) or name.lower() != "execute" or not isinstance(given, dict | None):
                raise Refused(-32602, "name must be Execute, and arguments an object")
            got = self.execute(**{k: v for k, v in (given or {}).items() if k in TOOL["inputSchema"]["properties"]})
            return {"content": [{"type": "text", "text": json.dumps(got, ensure_ascii=False)}], "isError": "error" in got}
        if method == "ping":
            return {}
        raise Refused(-32601, f"unknown method {method}")

    def run(self, lines: IO[str], out: IO[str]) -> None:
        """Answers until the input ends, whatever the lines hold."""
        for line in lines:
            if not line.strip():
                continue
            request: Any = None
            try:
                request = json.loads(line)
                if not isinstance(request, dict):
                    raise Refused(-32600, "a request must be an object")
                reply: dict[str, Any] = {"result": self.answer(request)}
            except Refused as e:
                reply = {"error": {"code": e.code, "message": str(e)}}
            except (ValueError, RecursionError) as e:
                reply = {"error": {"code": -32700, "message": str(e)}}
            except Exception as e:  # noqa: BLE001 - a failed request is an answer, not the end
                reply = {"error": {"code": -32603, "message": str(e)}}
            if isinstance(request, dict) and "id" not in request:
                continue  # a notification
            given = request.get("id") if isinstance(request, dict) else None
            print(json.dumps({"jsonrpc": "2.0", "id": given} | reply, ensure_ascii=False), file=out, flush=True)
        print("input ended", file=sys.stderr)
