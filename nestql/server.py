"""An HTTP endpoint: POST and GET on /graphql, a page to try queries on /graphiql, redirects to it elsewhere."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from nestql.engine import Engine

PAGE = """<!DOCTYPE html><html><head><title>nestql</title></head><body>
<textarea id="q" rows="20" cols="80">{ }</textarea><br><button onclick="run()">Run</button><pre id="out"></pre>
<script>async function run() { const r = await fetch('/graphql', {method: 'POST', headers: {'Content-Type': 'application/json'},
body: JSON.stringify({query: document.getElementById('q').value})}); document.getElementById('out').textContent = JSON.stringify(await r.json(), null, 2); }</script>
</body></html>"""


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: bytes, kind: str, **headers: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def run(self, request: dict) -> None:
            if not isinstance(request, dict) or not isinstance(request.get("query"), str):
                self.answer(400, b'{"errors": [{"message": "A query is missing"}]}', "application/json")
                return
            result = engine.execute(request["query"], request.get("variables"), request.get("operationName"))
            self.answer(200 if "data" in result else 400, json.dumps(result).encode(), "application/json")

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path == "/graphql":
                q = {k: v[0] for k, v in parse_qs(url.query).items()}
                try:
                    self.run(q | ({"variables": json.loads(q["variables"])} if "variables" in q else {}))
                except ValueError:
                    self.run({})
            elif url.path == "/graphiql":
                self.answer(200, PAGE.encode(), "text/html; charset=utf-8")
            else:
                self.answer(302, b"", "text/plain", Location="/graphiql")

        def do_POST(self) -> None:
            if urlsplit(self.path).path != "/graphql":
                self.answer(302, b"", "text/plain", Location="/graphiql")
                return
            try:
                self.run(json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0)))))
            except ValueError:
                self.run({})

        def log_message(self, *_args) -> None:
            pass

    return Handler


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``; all requests share the engine's Spark session."""
    return ThreadingHTTPServer((host, port), handler(engine))
