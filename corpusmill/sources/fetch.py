"""Fetching of feeds, robots files and pages through a pluggable adapter, politely."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import urls
from corpusmill.operators.crawl import AGENT

# Seconds between requests to one host and for one request, and further attempts.
DELAY, TIMEOUT, RETRIES = 1.0, 20.0, 3

#: An adapter: URL and whether to follow redirects, to status and body; raises OSError if there is no response.
Get = Callable[[str, bool], tuple[int, str]]


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args: object) -> None:
        return None


def http_get(url: str, follow: bool = True) -> tuple[int, str]:
    """Status and body over HTTP; the default adapter."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept-Language": "vi,en;q=0.7"})
    opener = urllib.request.build_opener() if follow else urllib.request.build_opener(_Stay)
    try:
        with opener.open(request, timeout=TIMEOUT) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def retryable(status: int) -> bool:
    return status == 429 or 500 <= status < 600


class Polite:
    """An adapter's calls with a pause between those to one host, and again after failures.

    A failure is an OSError or a status of 429 or 500 to 599; other statuses are results. The
    pause counts from the last call's beginning and is made once for all of its attempts.
    """

    def __init__(self, get: Get = http_get, delay: float = DELAY, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.get, self.delay, self.retries, self.sleep, self.clock = get, delay, retries, sleep, clock
        self.last: dict[str, float] = {}

    def __call__(self, url: str) -> str:
        host = urlsplit(url).netloc.lower()
        if host in self.last and (wait := self.delay - (self.clock() - self.last[host])) > 0:
            self.sleep(wait + random.uniform(0, 0.05))
        self.last[host] = self.clock()
        for k in range(self.retries + 1):
            try:
                status, body = self.get(url, True)
                if not retryable(status):
                    return body
                failure: Exception = OSError(f"retryable status {status}")
            except OSError as e:
                failure = e
            if k < self.retries:
                self.sleep(min(15.0, 2.0**k))
        raise failure


def fetch(rows: DataFrame, polite: Callable[[], Callable[[str], str]] = Polite, column: str = "url", tasks: int | None = None) -> DataFrame:
    """rows(url, ...) with body and error, one of them null.

    A host's rows lie in one task, whose Polite keeps the host's pauses; a null or bad URL is
    an error. polite makes the caller, once for each task. The result must be written before
    it is used twice, or pages are fetched again.
    """
    host = F.lower(F.regexp_extract(column, urls.PARTS, 2))
    dealt = rows.repartition(tasks, host) if tasks else rows.repartition(host)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = polite()
        for b in batches:
            bodies, errors = [], []
            for url in b.column(column).to_pylist():
                try:
                    bodies.append(call(url or ""))
                    errors.append(None)
                except (OSError, ValueError) as e:
                    bodies.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield b.append_column("body", pa.array(bodies, pa.string())).append_column("error", pa.array(errors, pa.string()))

    return dealt.mapInArrow(run, columns + ", body string, error string")


def fetch_robots(pages: DataFrame, get: Get = http_get) -> DataFrame:
    """host, body of robots.txt, once for each host of pages(url); a missing or failing one is empty, redirects are not followed."""
    part = lambda k: F.regexp_extract("url", urls.PARTS, k)
    hosts = pages.select(F.lower(part(2)).alias("host"), F.coalesce(F.nullif(F.lower(part(1)), F.lit("")), F.lit("https")).alias("scheme")).where("host <> ''").groupBy("host").agg(F.min("scheme").alias("scheme"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = []
            for host, scheme in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    status, body = get(f"{scheme}://{host}/robots.txt", False)
                    bodies.append(body if status < 400 else "")
                except (OSError, ValueError):
                    bodies.append("")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bodies, pa.string())], names=["host", "body"])

    return hosts.mapInArrow(run, "host string, body string")
