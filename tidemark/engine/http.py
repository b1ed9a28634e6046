"""The store and the database over HTTP, with Basic authentication on everything but the health check.

Every answer is ``{"success": true, "data": ...}`` or ``{"success": false, "error": text}``. Pages of any origin may ask.
The rows of a query are sent as they come, so a result may be larger than the driver's memory.
"""

from __future__ import annotations

import base64
import hmac
import json
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from tidemark.engine.errors import SqlError
from tidemark.engine.kv import KVStore
from tidemark.engine.result import Result
from tidemark.engine.session import Database

VERSION = "0.2.0"


def plain(v: object) -> object:
    """A value as JSON has it; numbers that JSON lacks become null, other types their text."""
    if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        return None
    return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)


def result_parts(sql: str, r: Result) -> Iterator[str]:
    """The whole answer to a query, in pieces."""
    head = {"query": sql, "result_type": "select", "columns": r.frame.columns}
    rows, n = r.stream(), 0
    first = next(rows, None)  # an error shows before anything is sent
    yield '{"success": true, "data": ' + json.dumps(head)[:-1] + ', "rows": ['
    while first is not None:
        yield (", " if n else "") + json.dumps([plain(v) for v in first])
        n, first = n + 1, next(rows, None)
    yield f'], "message": "{n} row(s) returned"}}}}'


def result_json(sql: str, r: Result) -> dict:
    out: dict = {"query": sql, "result_type": {"rows": "rows_affected"}.get(r.kind, r.kind)}
    if r.kind == "rows":
        out |= {"rows_affected": r.count, "message": r.text()}
    elif r.kind == "tables":
        out["tables"] = r.lines
    elif r.kind in ("describe", "indexes"):
        out |= {"table_name": r.name, "columns": r.columns, "rows": [list(v) for v in r.values]}
    else:
        out |= {"table_name": r.name or None, "message": r.text()}
    return out


def server(db: Database, kv: KVStore, user: str, password: str, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is not yet running."""
    wanted = "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def reply(self, status: int, body: object) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            if status == 401:
                self.send_header("WWW-Authenticate", 'Basic realm="tidemark"')
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def reply_parts(self, parts: Iterator[str]) -> None:
            """A body whose length is not known beforehand; its end is that of the connection."""
            first = next(parts)
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(first.encode())
            for part in parts:
                self.wfile.write(part.encode())

        def do_OPTIONS(self) -> None:
            """What a page of another origin asks before it asks."""
            self.send_response(200)
            for name in ("Origin", "Methods", "Headers"):
                self.send_header(f"Access-Control-Allow-{name}", "*")
            self.send_header("Content-Length", "0")
            self.end_headers()

        def body(self) -> object:
            data = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            return json.loads(data) if data else {}

        def handle_one(self) -> None:
            path = self.path.split("?")[0]
            if path == "/health":
                return self.reply(200, {"success": True, "data": {"status": "healthy", "version": VERSION}})
            if not hmac.compare_digest(self.headers.get("Authorization") or "", wanted):
                return self.reply(401, {"success": False, "error": "Unauthorized"})
            try:
                status, value = self.route(self.command, path)
                if isinstance(value, Iterator):
                    return self.reply_parts(value)
            except (ValueError, KeyError, TypeError) as error:
                return self.reply(400, {"success": False, "error": f"bad request: {error}"})
            except SqlError as error:
                return self.reply(400, {"success": False, "error": str(error)})
            except ConnectionError:
                raise
            except Exception as error:  # noqa: BLE001 - an error of a job ends the request, not the server
                return self.reply(500, {"success": False, "error": str(error).split("\n")[0]})
            return self.reply(status, {"success": False, "error": value} if isinstance(value, str) else {"success": True, "data": value})

        do_GET = do_POST = do_PUT = do_DELETE = handle_one

        def route(self, method: str, path: str) -> tuple[int, object]:
            match method, path:
                case "GET", "/kv/info":
                    return 200, {"keys_count": len(kv), "is_empty": kv.is_empty(), "wal_size_bytes": kv.wal_bytes()}
                case "POST", "/kv/clear":
                    kv.clear()
                    return 200, {"cleared": True}
                case "POST", "/kv/snapshot":
                    kv.snapshot()
                    return 200, {"snapshot": True}
                case "POST", "/kv/flush":
                    kv.flush()
                    return 200, {"flushed": True}
                case "POST", "/kv/mget":
                    keys = self.body()["keys"]
                    found = dict(kv.get_many(keys))
                    return 200, [{"key": k, "value": found.get(k), "exists": k in found} for k in keys]
                case "POST", "/kv/mset" | "/kv/" | "/kv":
                    given = self.body()["pairs"]
                    pairs = {p["key"]: p["value"] for p in given} if isinstance(given, list) else given
                    if not all(isinstance(v, str) for v in pairs.values()):
                        raise ValueError("values are strings")
                    kv.set_many(pairs)
                    return 200, {"requested": len(given), "set": len(pairs)}
                case "POST", "/sql/execute":
                    sql = self.body()["query"]
                    result = db.execute(sql)
                    return 200, result_parts(sql, result) if result.kind == "select" else result_json(sql, result)
                case "GET", "/sql/tables":
                    tables = db.tables()
                    return 200, {"tables": tables, "count": len(tables)}
                case "POST", "/sql/save":
                    return 200, {"saved": True}
            if path.startswith("/kv/") and len(path) > 4:
                key = unquote(path[4:])
                if method == "GET":
                    value = kv.get(key)
                    return 404 if value is None else 200, {"key": key, "value": value, "exists": value is not None}
                if method in ("PUT", "POST"):
                    value = self.body()["value"]
                    if not isinstance(value, str):
                        raise ValueError("a value is a string")
                    (kv.set if method == "PUT" else kv.set_async)(key, value)
                    return 200, {"key": key, "value": value, "exists": True}
                if method == "DELETE":
                    deleted = kv.delete(key)
                    return 200 if deleted else 404, {"key": key, "deleted": deleted}
            return 404, "Not found"

    return ThreadingHTTPServer((host, port), Handler)
