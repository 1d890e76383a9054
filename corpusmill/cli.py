"""Command line: crawl, label, split, serve.

crawl fetches feeds, robots files and pages, or works on fetched data: --feeds (source,
feed_pos, body) and --pages (url, html, error), Parquet or JSONL by their names. label asks
the hosted models with keys from the environment, or --labeler module:function, a function of
the system and the user prompt.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import server
from corpusmill.functions.splits import SPLITS
from corpusmill.functions.urls import PARTS, canonicalize_url
from corpusmill.operators import crawl, dataset, labeling, qc, summarize
from corpusmill.session import get_session
from corpusmill.sources import feeds, fetch, jsonl
from corpusmill.sources.store import importable, written

ARTICLES = "article_id bigint, source string, url string, title string, category string, published_at string, content_text string"
LABELED = ARTICLES + ", summary string, prompt_version string, qc_passed boolean"
#: Articles of a demonstration.
DEMO_ARTICLES = 5
#: Split sizes of the published dataset.
V2_COUNTS = {"train": 1636, "val": 218, "test": 216}


def flattened(path: str) -> bool:
    """Whether a path looks as if a shell had eaten its separators: data... .jsonl without any."""
    low = path.lower()
    return "/" not in path and "\\" not in path and low.startswith("data") and low.endswith(".jsonl")


def any_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return jsonl.read_jsonl(spark, path, schema) if ".json" in path else spark.read.parquet(path)


def article_limit(mode: str, limit: int | None) -> int | None:
    return limit if limit is not None else DEMO_ARTICLES if mode == "demo" else None


def crawled(spark: SparkSession, feeds_path: str | None, pages_path: str | None, only: list[str] | None, limit: int | None, get: fetch.Get = fetch.http_get) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles, outcomes and sources of a crawl of given tables, or of what get fetches where they are not given.

    Pages are fetched once each, in any order; with a limit only those of as many candidates as
    it takes, in growing heads.
    """
    chosen = feeds.enabled_sources(feeds.sources(spark), only)
    polite = lambda: fetch.Polite(get)
    if feeds_path:
        bodies = any_table(spark, feeds_path, "source string, feed_pos int, body string")
    else:
        urls_of = feeds.feed_urls(chosen).select("source", "feed_pos", F.col("feed_url").alias("url"))
        bodies, _ = written(fetch.fetch(urls_of, polite), "feeds")
    found, _ = written(crawl.candidates(feeds.parse_feeds(bodies.select("source", "feed_pos", "body")), chosen), "candidates")
    if pages_path:
        pages = any_table(spark, pages_path, "url string, html string, error string").withColumn("url", canonicalize_url(F.col("url")))
        return (*crawl.crawl(found, pages, None, limit), chosen)
    n = found.count()
    head = n if limit is None else crawl.first_head(limit)
    robots = pages = None
    while True:
        wanted = found.orderBy(*crawl.ORDER).limit(head).select("url").distinct()
        if pages is not None:
            wanted = wanted.join(pages.select("url"), "url", "left_anti")
        rules, _ = written(fetch.fetch_robots(wanted if robots is None else wanted.join(robots, F.lower(F.regexp_extract("url", PARTS, 2)) == robots["host"], "left_anti"), get), "robots")
        robots = rules if robots is None else robots.unionByName(rules)
        fetched, _ = written(fetch.fetch(crawl.with_robots(wanted, robots).where("allowed").select("url"), polite).withColumnRenamed("body", "html"), "pages")
        pages = fetched if pages is None else pages.unionByName(fetched)
        articles, outcomes = crawl.crawl(found, pages, robots, limit)
        if limit is None or head >= n or articles.count() >= limit:
            return articles, outcomes, chosen
        head *= 4


def run_crawl(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.output and flattened(a.output):
        print(f"the output path has no separators, as if the shell had taken them: {a.output}", file=sys.stderr)
        return 2
    articles, outcomes, chosen = crawled(spark, a.feeds, a.pages, a.source, article_limit(a.mode, a.limit))
    records = crawl.to_record(articles).orderBy("article_id")
    if a.output:
        jsonl.write_jsonl(records, a.output)
        n = jsonl.read_jsonl(spark, a.output, ARTICLES).count()
        print(f"wrote {n} articles to {a.output}")
    else:
        found = [{**{c: None for c in crawl.RECORD}, **json.loads(x)} for x in records.toJSON().collect()]
        print(json.dumps(found, ensure_ascii=False, indent=2))
        n = len(found)
    for s in crawl.crawl_stats(outcomes, chosen).collect():
        if a.verbose or s.errors:
            print(s.asDict(), file=sys.stderr)
    return 0 if n else 1


def named(spec: str) -> Callable:
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def run_label(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = jsonl.read_jsonl(spark, a.input, ARTICLES)
    models = a.model or list(labeling.MODELS)
    generate = named(a.labeler) if a.labeler else labeling.RotatingLabeler(named(a.client) if a.client else labeling.gemini_call, labeling.api_keys(os.environ), models)
    labeled = labeling.label_rows(rows, generate, a.concurrency, a.limit)
    jsonl.write_jsonl(labeled, a.output)
    counts = qc.qc_counts(jsonl.read_jsonl(spark, a.output, labeled.schema)).first()
    print(f"labeled={counts.total} qc_passed={counts.passed} qc_failed={counts.failed} prompt={labeling.PROMPT_VERSION} model={models[0]}")
    return 0 if counts.total else 1


def run_split(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = dataset.split_rows(jsonl.read_jsonl(spark, a.input, LABELED))
    jsonl.write_splits(rows, a.output, SPLITS)
    counts = dataset.split_counts(jsonl.read_splits(spark, a.output, SPLITS, rows.drop("split").schema)).first().asDict()
    print(json.dumps(counts, indent=2))
    if a.check_v2_counts and counts != V2_COUNTS:
        print(f"expected {V2_COUNTS}, got {counts}")
        return 1
    return 0


def run_serve(spark: SparkSession, a: argparse.Namespace) -> int:
    find = lambda limit: crawled(spark, a.feeds, a.pages, None, limit)[0]
    names = {k: os.environ.get(v) for k, v in (("model_id", "HF_MODEL_ID"), ("base_id", "HF_BASE_MODEL_ID"), ("token", "HF_TOKEN"), ("device", "MODEL_DEVICE"))}
    load = (lambda: summarize.sequence_model(**names)) if names["model_id"] else (lambda: summarize.leading_sentences)
    server.server(find, summarize.summarizer(load), a.port).serve_forever()
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusmill", description=__doc__)
    sub = p.add_subparsers(required=True)
    c = sub.add_parser("crawl")
    c.add_argument("--mode", choices=("labeling", "demo"), default="labeling")
    c.add_argument("--output")
    c.add_argument("--limit", type=int)
    c.add_argument("--source", action="append")
    c.add_argument("--verbose", action="store_true")
    c.add_argument("--feeds")
    c.add_argument("--pages")
    c.set_defaults(run=run_crawl)
    lab = sub.add_parser("label")
    lab.add_argument("--input", required=True)
    lab.add_argument("--output", required=True)
    lab.add_argument("--limit", type=int)
    lab.add_argument("--concurrency", type=int, default=5)
    lab.add_argument("--labeler", help="module:function of the prompts, instead of hosted models")
    lab.add_argument("--client", help="module:function of model, key and prompts")
    lab.add_argument("--model", action="append", help="a model to ask; further ones are asked where it is unavailable")
    lab.set_defaults(run=run_label)
    s = sub.add_parser("split")
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--check-v2-counts", action="store_true")
    s.set_defaults(run=run_split)
    srv = sub.add_parser("serve")
    srv.add_argument("--feeds")
    srv.add_argument("--pages")
    srv.add_argument("--port", type=int, default=8000)
    srv.set_defaults(run=run_serve)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or get_session()
    importable(spark)
    try:
        return args.run(spark, args)
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
