"""The crawl as staged relations: candidates, first of each URL, robots, pages, text, near copies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from corpusmill.functions import dates, text, urls
from corpusmill.functions.html import EXTRACTED, FIELDS, extract
from corpusmill.operators.near_dup import fingerprint, near_dup_kept
from corpusmill.sources.store import written

COUNTERS = ("discovered", "fetched", "extracted", "skipped_duplicate", "skipped_robots", "fetch_failed", "extract_failed")
ORDER = ["source_pos", "feed_pos", "entry_pos"]
#: What the crawler calls itself.
AGENT = "corpusmill/1.0"
RECORD = ("article_id", "source", "url", "title", "category", "published_at", "content_text")


@F.pandas_udf(StructType([*EXTRACTED, StructField("fp", LongType())]))
def extract_with_print(html: pd.Series) -> pd.DataFrame:
    """extract_html() and the text's fingerprint, null without a text, in one turn of one worker."""
    found = [extract(h) for h in html]
    prints = [None if x["content_text"] is None else fingerprint(x["content_text"]) for x in found]
    return pd.DataFrame(found, columns=FIELDS).assign(fp=pd.array(prints, dtype="Int64"))


def some(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def candidates(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Feed entries with link and title, capped for each feed, as rows in crawl order (seq columns source_pos, feed_pos, entry_pos)."""
    capped = entries.join(F.broadcast(sources.select("source_pos", F.col("id").alias("source"), F.col("name").alias("source_name"), "max_items_per_feed")), "source")
    capped = capped.where("link <> ''").where(text.strip(F.col("title")) != "").withColumn("title", text.normalize_text(F.col("title")))
    within = Window.partitionBy("source", "feed_pos").orderBy("entry_pos")
    capped = capped.withColumn("_n", F.row_number().over(within)).where("max_items_per_feed is null or _n <= max_items_per_feed")
    raw = some(F.get("tags", 0)["term"], urls.category_from_url(F.col("link")))
    published = some(F.col("published"), F.col("updated"), F.col("pubDate"), F.col("dc_date"))
    return capped.select("source_pos", "feed_pos", "entry_pos", "source", "source_name", urls.canonicalize_url(F.col("link")).alias("url"), "title", dates.to_utc(published).alias("published_at"), urls.canonical_category(raw).alias("category"), "author")


def first_of_url(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with is_first: whether the row is the first of its url in `order`."""
    return rows.withColumn("is_first", F.row_number().over(Window.partitionBy("url").orderBy(*order)) == 1)


def robots_allow(agent: str = AGENT) -> Callable[[Column, Column, Column], Column]:
    """A column function of robots.txt, URL and host: whether `agent` may fetch the URL; no robots.txt allows all, no host nothing."""

    @F.pandas_udf(BooleanType())
    def run(series: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for body, url, host in series:
            known: dict[str, RobotFileParser] = {}

            def rules(b: str, known: dict[str, RobotFileParser] = known) -> RobotFileParser:
                if b not in known:
                    known[b] = RobotFileParser()
                    known[b].parse(b.splitlines())
                return known[b]

            yield pd.Series([bool(h) and rules(b or "").can_fetch(agent, u) for b, u, h in zip(body, url, host, strict=True)], dtype="bool")

    return run


def with_robots(rows: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """rows(url, ...) with allowed, from robots(host, body)."""
    host = F.lower(F.regexp_extract("url", urls.PARTS, 2))
    joined = rows.withColumn("host", host).join(robots.select("host", F.col("body").alias("_robots")), "host", "left")
    return joined.withColumn("allowed", robots_allow(agent)("_robots", "url", "host")).drop("_robots", "host")


def crawl(found: DataFrame, pages: DataFrame, robots: DataFrame | None = None, limit: int | None = None, agent: str = AGENT) -> tuple[DataFrame, DataFrame]:
    """Articles and outcomes of candidates.

    pages: url (canonical), html, error (null if it was fetched). A URL counts as seen before
    robots, fetch and extraction, so a later copy of one that failed is a duplicate. Near
    copies are compared with kept articles only. Returns articles (all columns, article_id
    from 1 in crawl order) and outcomes (source, outcome, error and the crawl order), one for
    each candidate.

    With a limit the crawl ends with that many articles: candidates after the last one have a
    null outcome, and sources that were not begun by then have no rows. What comes later
    decides nothing, so growing heads of the candidates are crawled until one is enough.
    """
    if limit is None:
        return crawl_all(found, pages, robots, agent)
    head, n = first_head(limit), found.count()
    while True:
        some_, _ = written(found.orderBy(*ORDER).limit(head), "candidates")
        articles, outcomes = crawl_all(some_, pages, robots, agent)
        articles, _ = written(articles.where(F.col("article_id") <= max(limit, 0)), "articles")
        if head >= n or articles.count() >= limit:
            break
        head *= 4
    # The place of the last article; null where all candidates are too few, before all of them where none is wanted.
    seq = F.struct(*ORDER)
    nowhere = F.struct(*(F.lit(-1).alias(c) for c in ORDER))
    end = articles.where(F.col("article_id") == limit).agg(F.max(seq)).scalar() if limit > 0 else nowhere
    begun = found.where(seq > end).agg(F.min("source_pos")).scalar()
    reached = outcomes.where(end.isNull() | (seq <= end))
    null = F.lit(None).cast("string")
    others = found.where((seq > end) & (F.col("source_pos") <= begun)).select("source", null.alias("outcome"), null.alias("error"), *ORDER)
    return articles, reached.unionByName(others)


def first_head(limit: int) -> int:
    """Candidates that a crawl with a limit looks at first."""
    return max(64, 4 * limit)


def crawl_all(found: DataFrame, pages: DataFrame, robots: DataFrame | None, agent: str) -> tuple[DataFrame, DataFrame]:
    """crawl() without a limit; articles keep the crawl order's columns."""
    rows = first_of_url(found, ORDER)
    rows = with_robots(rows, robots, agent) if robots is not None else rows.withColumn("allowed", F.lit(True))
    fetched = rows.join(pages.select("url", "html", F.col("error").alias("fetch_error")), "url", "left")
    tried = F.col("is_first") & F.col("allowed")
    got = tried & F.col("html").isNotNull() & F.col("fetch_error").isNull()
    # Only what was fetched reaches the parser.
    parsed = fetched.where(got).withColumn("_x", extract_with_print("html")).withColumn("content_text", F.coalesce("_x.content_text", F.lit("")))
    parsed = parsed.withColumn("word_count", text.word_count(F.col("content_text"))).withColumn("fp", F.when(F.col("word_count") >= 50, F.col("_x.fp")))
    why = F.concat("url", F.lit(": "), F.coalesce("fetch_error", F.lit("not fetched")))
    rest = fetched.where(~F.coalesce(got, F.lit(False))).select("source", F.when(~F.col("is_first"), "skipped_duplicate").when(~F.col("allowed"), "skipped_robots").otherwise("fetch_failed").alias("outcome"), F.when(tried, why).alias("error"), *ORDER)
    texts, _ = written(parsed.select(*found.columns, "_x", "content_text", "word_count", "fp"), "texts")
    kept = near_dup_kept(texts.where("fp is not null").select(F.struct(*ORDER).alias("seq"), "fp")).select("seq.*", F.lit(True).alias("_kept"))
    judged = texts.join(kept, ORDER, "left").withColumn("outcome", F.when(F.col("fp").isNull(), "extract_failed").when(F.col("_kept"), "extracted").otherwise("near_duplicate"))
    outcomes = rest.union(judged.select("source", "outcome", F.lit(None).cast("string"), *ORDER))
    # Article numbers: offsets of the sources, then ranks within each.
    articles = judged.where("outcome = 'extracted'")
    before = articles.groupBy("source_pos").agg(F.count("*").alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(Window.orderBy("source_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source_pos", "_base")
    rank = F.row_number().over(Window.partitionBy("source_pos").orderBy("feed_pos", "entry_pos"))
    articles = articles.join(before, "source_pos").withColumn("article_id", (F.col("_base") + rank).cast("bigint"))
    stamp = F.date_format(F.coalesce(dates.to_utc(F.col("_x.published")), F.col("published_at")), "yyyy-MM-dd'T'HH:mm:ssxxx")
    title = text.normalize_text(some(F.col("_x.title"), F.col("title")))
    out = articles.select("article_id", "source", "source_name", "url", title.alias("title"), "category", stamp.alias("published_at"), some(F.col("_x.author"), F.col("author")).alias("author"), "content_text", "word_count", urls.url_hash(F.col("url")).alias("url_hash"), *ORDER)
    return out, outcomes


def crawl_stats(outcomes: DataFrame, sources: DataFrame) -> DataFrame:
    """Counters of every source and its errors in crawl order, also of those without candidates."""
    o = F.col("outcome")
    reached = ("extracted", "extract_failed", "near_duplicate")
    one = {c: o == c for c in COUNTERS[2:]} | {"skipped_duplicate": o.isin("skipped_duplicate", "near_duplicate")}
    counts = outcomes.groupBy("source").agg(F.count("*").alias("discovered"), F.count_if(o.isin(*reached)).alias("fetched"), *(F.count_if(test).alias(c) for c, test in one.items()), F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct(*ORDER, "error")))), lambda e: e["error"]).alias("errors"))
    all_sources = sources.where("enabled").select("source_pos", F.col("id").alias("source"))
    joined = all_sources.join(counts, "source", "left").na.fill(0, list(COUNTERS))
    return joined.orderBy("source_pos").select("source", *COUNTERS, F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def to_record(articles: DataFrame) -> DataFrame:
    return articles.select(*RECORD)
