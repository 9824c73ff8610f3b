"""A small server that shows the chunks of one text: JSON in, JSON out, and a page to try it."""

from __future__ import annotations

import json
import mimetypes
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import SparkSession

from .errors import TextloomError
from .operators.code import chunk_code
from .operators.documents import chunk_documents, words
from .sources.sinks import view

_PAGE = """<!doctype html><meta charset="utf-8"><title>Chunks</title><textarea id="t" rows="12" cols="90"></textarea><br>
Sentences <input id="n" type="number" value="3" min="1"> <button onclick="go()">Chunk</button><pre id="o"></pre>
<script>async function go(){const r=await fetch('/api/chunk',{method:'POST',body:JSON.stringify({name:'a.txt',text:t.value,mode:'document',params:{max_sentences:+n.value}})});
o.textContent=(await r.json()).chunks.map((c,i)=>'--- '+(i+1)+'\\n'+c.content).join('\\n\\n')}</script>"""


def chunks_of(spark: SparkSession, request: dict[str, Any], counter=words) -> dict[str, Any]:
    """Text, chunks and statistics for a request: name, text, mode (document or code), params."""
    mode, text, params = request.get("mode", "document"), request["text"], dict(request.get("params") or {})
    df = spark.createDataFrame([(request.get("name", "text"), text)], "source string, text string")
    if "max_tokens" in params:
        params["token_counter"] = counter
    made = chunk_code(df, code="text", **params) if mode == "code" else chunk_documents(df, key="source", **params)
    return view(text, made, mode)


def handler(spark: SparkSession, counter=words) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def send(self, status: int, body: Any, kind: str = "application/json") -> None:
            data = body.encode() if isinstance(body, str) else json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            pages = {"/": (_PAGE, "text/html"), "/health": ({"status": "ok"}, "application/json"), "/api/token_counter_status": ({"token_counter_available": counter is not None}, "application/json")}
            body, kind = pages.get(self.path, ({"error": "not found"}, "application/json"))
            self.send(200 if self.path in pages else 404, body, kind)

        def do_POST(self) -> None:
            if self.path != "/api/chunk":
                return self.send(404, {"error": "not found"})
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                if not isinstance(request, dict) or not isinstance(request.get("text"), str):
                    raise ValueError("no text")
            except ValueError as e:
                return self.send(400, {"error": f"The request isn't valid: {e}"})
            if not (mimetypes.guess_type(request.get("name", "a.txt"))[0] or "text/plain").startswith("text/"):
                return self.send(400, {"error": "Only text can be shown"})
            try:
                self.send(200, chunks_of(spark, request, counter))
            except (TextloomError, TypeError) as e:
                self.send(400, {"error": str(e)})
            except Exception as e:
                self.send(500, {"error": str(e)[:500]})

        def log_message(self, *args: Any) -> None:
            pass

    return Handler


def serve(spark: SparkSession, host: str, port: int, counter=words) -> None:
    with ThreadingHTTPServer((host, port), handler(spark, counter)) as server:
        print(f"http://{host}:{port}/")
        server.serve_forever()
