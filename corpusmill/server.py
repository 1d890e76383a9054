"""HTTP: a page, a health check, and summaries of what a crawl finds now."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Callable, Mapping
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import summarize

VERSION = "1.0"
#: Articles of one request where MAX_ARTICLES_PER_DEMO does not say.
ARTICLES = 5

#: limit to articles, as crawl() gives them.
Crawl = Callable[[int], DataFrame]
PAGE = """<!doctype html><meta charset="utf-8"><title>Summaries</title><h1>Summaries of up to {n} articles</h1>
<button onclick="fetch('/api/summarize-today',{{method:'POST'}}).then(r=>r.text()).then(t=>out.textContent=t)">Summarize</button><pre id="out"></pre>"""


def article_limit(env: Mapping[str, str] = os.environ) -> int:
    return int(env.get("MAX_ARTICLES_PER_DEMO") or ARTICLES)


def summarize_today(crawl: Crawl, summary: Callable[[Column], Column], limit: int) -> tuple[int, dict]:
    """Status and answer: 502 if the crawl finds nothing, 500 if the model fails."""
    found = crawl(limit)
    if found.isEmpty():
        return 502, {"detail": "No article could be crawled and extracted."}
    try:
        row = summarize.response(found, summary(F.col("content_text")), date.today().isoformat()).first()
    except Exception as e:  # noqa: BLE001 whatever a model raises is an answer, not a crash
        return 500, {"detail": f"Model inference failed: {e}"}
    return 200, row.asDict(recursive=True)


def answer(method: str, path: str, crawl: Crawl, summary: Callable[[Column], Column]) -> tuple[int, str, str]:
    """Status, content type and body of a request."""
    if (method, path) == ("GET", "/"):
        return 200, "text/html; charset=utf-8", PAGE.format(n=html.escape(str(article_limit())))
    if (method, path) == ("GET", "/healthz"):
        status, found = 200, {"status": "ok", "version": VERSION}
    elif (method, path) == ("POST", "/api/summarize-today"):
        status, found = summarize_today(crawl, summary, article_limit())
    else:
        status, found = 404, {"detail": "Not Found"}
    return status, "application/json", json.dumps(found, ensure_ascii=False)


def server(crawl: Crawl, summary: Callable[[Column], Column], port: int = 8000) -> ThreadingHTTPServer:
    """A server of answer(); serve_forever() runs it."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self) -> None:
            status, kind, body = answer(self.command, self.path.partition("?")[0], crawl, summary)
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = reply  # noqa: N815 names of the base class

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
