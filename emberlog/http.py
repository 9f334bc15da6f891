"""A small HTTP front with the endpoints that LogsQL clients use."""

from __future__ import annotations

import hmac
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from emberlog.api import Emberlog
from emberlog.functions.times import query_time
from emberlog.operators.search import Page
from emberlog.plans import logsql
from emberlog.plans.filters import LogFilter
from emberlog.sources import ndjson
from emberlog.sources.model import ENTRY


def whole(text: str | None) -> int | None:
    found = logsql.LEADING_INT.match(text or "")
    return int(found[0]) if found else None


def get_filter(params: dict[str, str]) -> tuple[LogFilter, str, int | None, int | None]:
    """Filter, order, limit and offset of a GET query; what can't be read is left out."""
    time_ = lambda k: query_time(params[k]) if k in params else None
    where = LogFilter.of(params.get("level"), params.get("message"))
    since, until = time_("start"), time_("end")
    where = where.but(since=() if since is None else (since,), until=() if until is None else (until,), nothing="level" in params and params["level"] not in logsql.KNOWN_LEVELS)
    return where, "asc" if params.get("order") == "asc" else "desc", whole(params.get("limit")), whole(params.get("offset"))


class App:
    """Requests as (status, content type, body); the server below only carries them."""

    def __init__(self, log: Emberlog, token: str | None = None, backup_dir: str | None = None):
        self.log, self.token, self.backup_dir = log, token, backup_dir

    def allowed(self, header: str | None, params: dict[str, str]) -> int:
        """200, 401 without a token, 403 with a wrong one."""
        if self.token is None:
            return 200
        given = header[7:] if (header or "").startswith("Bearer ") else params.get("token")
        return 401 if given is None else 200 if hmac.compare_digest(given.encode(), self.token.encode()) else 403

    def handle(self, method: str, target: str, body: bytes = b"", authorization: str | None = None) -> tuple[int, str, bytes]:
        url = urlsplit(target)
        params = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
        route = f"{method} {url.path}"
        if route == "GET /health":
            return self.json(self.health())
        serve = {
            "POST /insert/jsonline": self.insert, "GET /select/logsql/query": self.get_query, "POST /select/logsql/query": self.post_query, "POST /select/logsql/field_values": self.values,
            "POST /select/logsql/field_names": self.names, "GET /select/logsql/stats": self.stats, "POST /api/v1/backup": self.backup, "GET /api/v1/flush": self.flush,
        }.get(route)
        if serve is None:
            return 404, "text/plain", b"not found"
        status = self.allowed(authorization, params)
        if status != 200:
            return self.json({"error": "unauthorized" if status == 401 else "forbidden"}, status)
        if len(body) > self.log.config.body_limit:
            return self.json({"error": "body too large"}, 413)
        try:
            return serve(params, body)
        except ValueError as odd:
            return self.json({"error": str(odd)}, 400)
        except Exception as failed:
            return self.json({"error": type(failed).__name__}, 500)

    @staticmethod
    def json(value: object, status: int = 200) -> tuple[int, str, bytes]:
        return status, "application/json", json.dumps(value, ensure_ascii=False).encode()

    def lines(self, page: Page) -> tuple[int, str, bytes]:
        if not page.entries:
            return 200, "application/x-ndjson", b""
        rows = self.log.spark.createDataFrame([tuple(r[n] for n in ENTRY.names) for r in page.entries], ENTRY).coalesce(1)
        return 200, "application/x-ndjson", "\n".join(r[0] for r in ndjson.render(rows).collect()).encode()

    def parsed(self, body: bytes) -> logsql.LogQuery:
        form = parse_qs(body.decode("utf-8", "replace"), keep_blank_values=True)
        return logsql.parse(form.get("query", ["*"])[-1], self.log.clock())

    def health(self) -> dict:
        s = self.log.stats()
        return {"status": "ok", "blocks": s["total_blocks"], "entries": s["total_entries"], "disk_size": s.get("total_bytes", 0), "queued_entries": s["queued_entries"], "raw_debt_bytes": s.get("raw_bytes", 0)}

    def insert(self, params, body):
        n, errors = self.log.ingest_ndjson(body.decode("utf-8", "replace"), params.get("_msg_field", "_msg"), params.get("_time_field", "_time"))
        return self.json({"entries": n, "errors": errors}) if errors else (204, "text/plain", b"")

    def get_query(self, params, body):
        where, order, limit, offset = get_filter(params)
        return self.lines(self.log.query(order, limit, offset, False, where=where))

    def post_query(self, params, body):
        q = self.parsed(body)
        if q.count:
            return 200, "application/x-ndjson", json.dumps({"total": self.log.count(where=q.where)}).encode()
        return self.lines(self.log.query("asc" if q.ascending else "desc", q.limit, q.offset, False, where=q.where))

    def values(self, params, body):
        if "field" not in params:
            raise ValueError("field is missing")
        return self.json({"values": self.log.field_values(params["field"], self.parsed(body).where)})

    def names(self, params, body):
        return self.json({"values": self.log.field_names(self.parsed(body).where)})

    def stats(self, params, body):
        return self.json(self.log.stats())

    def backup(self, params, body):
        try:
            asked = json.loads(body or b"{}")
        except ValueError:
            asked = {}
        path = asked.get("path") if isinstance(asked, dict) else None
        target = path if isinstance(path, str) and path else f"{self.backup_dir or self.log.store.path + '-backups'}/{int(time.time())}"
        return self.json({"status": "ok"} | self.log.backup(target))

    def flush(self, params, body):
        self.log.flush()
        return self.json({"status": "ok"})


def serve(app: App, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Starts serving in a thread; ``server_port`` of the result has the port, ``shutdown()`` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            length = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(min(length, app.log.config.body_limit + 1))
            status, kind, out = app.handle(self.command, self.path, body, self.headers.get("Authorization"))
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = answer

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
