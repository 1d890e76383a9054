"""URL, crawl and streaming-like queries over pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import dates, urls
from corpusmill.functions.html import extract_html
from corpusmill.operators import crawl, summarize
from corpusmill.sources import feeds
from corpusmill.sources.store import table
from corpusmill.streaming.dedupe import first_by_key


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def q_canonical_url(spark, d):
    return pages(spark, d).select("page_id", urls.canonicalize_url(F.col("url")).alias("url"))


def q_url_hash(spark, d):
    return pages(spark, d).select("page_id", urls.url_hash(F.col("url")).alias("hash"))


def q_tracking_param_counts(spark, d):
    pairs = pages(spark, d).select(F.explode(urls.query_pairs(F.regexp_extract("url", urls.PARTS, 4))).alias("p"))
    return pairs.groupBy("p.k").agg(F.count("*").alias("n")).select("k", urls.is_tracking(F.col("k")).alias("tracking"), "n")


def q_url_first_wins(spark, d):
    rows = pages(spark, d).select("page_id", urls.canonicalize_url(F.col("url")).alias("url"))
    return crawl.first_of_url(rows, ["page_id"])


def q_category_from_url(spark, d):
    return pages(spark, d).select("page_id", urls.category_from_url(F.col("url")).alias("category"))


def q_canonical_category(spark, d):
    raw = urls.category_from_url(F.col("url"))
    return pages(spark, d).select("page_id", raw.alias("raw"), urls.canonical_category(raw).alias("category"))


def q_rfc2822_dates(spark, d):
    """Times of events written with four zones, by user, and read back."""
    zone = F.element_at(F.array(*map(F.lit, ZONES)), (F.col("user_id") % len(ZONES) + 1).cast("int"))
    day = F.element_at(F.array(*map(F.lit, DAYS)), F.weekday("ts") + 1)
    raw = F.concat_ws(" ", F.concat(day, F.lit(",")), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), zone)
    return table(spark, d, "events").select("event_id", F.date_format(dates.to_utc(raw), "yyyy-MM-dd HH:mm:ss").alias("utc"))


DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
#: Zones and the minutes they are ahead.
ZONES = {"+0700": 420, "-0000": 0, "GMT": 0, "+0530": 330}


def crawled(spark: SparkSession, d: str, limit: int | None = None, outages: bool = False):
    """The pages as a crawl: dealt to sources by id and to feeds of 100 ids each, in id order.

    The table is no feed, so no source's cap holds. With outages, every tenth URL times out.
    """
    conf = feeds.sources(spark).withColumn("max_items_per_feed", F.lit(None).cast("int"))
    n = conf.where("enabled").count()
    p = pages(spark, d)
    entries = p.select(F.element_at(F.array(*(F.lit(s[0]) for s in feeds.SOURCES[:n])), (F.col("page_id") % n + 1).cast("int")).alias("source"), F.floor(F.col("page_id") / (n * 100)).cast("int").alias("feed_pos"), F.col("page_id").cast("int").alias("entry_pos"), F.col("url").alias("link"), F.concat(F.lit("Page "), "page_id").alias("title"), *(F.lit(None).cast("string").alias(c) for c in ("published", "updated", "pubDate", "dc_date", "author")), F.array().cast("array<struct<term:string>>").alias("tags"))
    fetched = p.withColumn("url", urls.canonicalize_url(F.col("url"))).groupBy("url").agg(F.min_by("html", "page_id").alias("html"), F.min("page_id").alias("i")).select("url", "html", F.when(F.lit(outages) & (F.col("i") % 10 == 9), "timeout").alias("error"))
    chosen = feeds.enabled_sources(conf)
    return (*crawl.crawl(crawl.candidates(entries, chosen), fetched, limit=limit), chosen)


def q_crawl_articles(spark, d):
    return crawled(spark, d)[0].select("article_id", "source", "url", "title", "word_count", "url_hash")


def q_crawl_limit(spark, d):
    return crawled(spark, d, limit=5)[0].agg(F.count("*").alias("n"), F.max("article_id").alias("last"))


def q_crawl_stats(spark, d):
    _, outcomes, chosen = crawled(spark, d)
    return crawl.crawl_stats(outcomes, chosen).withColumn("errors", F.size("errors").cast("bigint"))


def q_crawl_discovered(spark, d):
    """Counters that do not depend on texts. The timeouts belong to its SQL, which counts them."""
    _, outcomes, chosen = crawled(spark, d, outages=True)
    return crawl.crawl_stats(outcomes, chosen).select("source", "discovered", "fetched", "fetch_failed")


def q_html_extract(spark, d):
    return pages(spark, d).select("page_id", extract_html("html").alias("x")).select("page_id", "x.*")


def q_summary_response(spark, d):
    articles, _, _ = crawled(spark, d, limit=5)
    return summarize.response(articles, summarize.summarizer()(F.col("content_text")), "2024-01-01").select("date", "total", F.to_json("items").alias("items"))


def q_events_dedupe(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return first_by_key(events, ["user_id", "event_type"], "ts", tie="event_id").select("event_id", "user_id", "event_type")


QUERIES = {k.removeprefix("q_"): v for k, v in list(globals().items()) if k.startswith("q_")}

# Test URLs have neither default ports nor escapes, so the SQL leaves both aside.
PAIRS = "list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.+$')), lambda p: {'k': split_part(p, '=', 1), 'v': regexp_replace(p, '^[^=]*=', '')})"
TRACKED = f"regexp_matches(lower({{}}), '^(?:{'|'.join(urls.TRACKING)})')"
KEPT = f"array_to_string(list_transform(list_sort(list_filter({PAIRS}, lambda p: NOT {TRACKED.format('p.k')})), lambda p: p.k || '=' || p.v), '&')"
PATH = "regexp_replace(coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), '/'), '/{2,}', '/', 'g')"
CANON = f"""lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')) || CASE WHEN {PATH} <> '/' THEN regexp_replace({PATH}, '/$', '') ELSE {PATH} END || CASE WHEN {KEPT} <> '' THEN '?' || {KEPT} ELSE '' END"""
URLS = f"(SELECT page_id, {CANON} AS url FROM pages)"
FROM_URL = r"lower(replace(nullif(regexp_extract(url, '^[^/]*//[^/]*/(?:/)?([\p{L}\p{N}_\-]+)/', 1), ''), '-', '_'))"
CATEGORY = "CASE WHEN coalesce(raw, '') = '' THEN NULL " + " ".join("WHEN " + " OR ".join(f"contains(lower(raw), '{a}') OR contains('{a}', lower(raw))" for a in aliases) + f" THEN '{key}'" for key, aliases in urls.CATEGORIES.items()) + " END"
NAMES = "[" + ", ".join(f"'{s[0]}'" for s in feeds.SOURCES if s[3]) + "]"


ORACLE_SQL = {
    "canonical_url": f"SELECT page_id, url FROM {URLS}",
    "url_hash": f"SELECT page_id, sha256(url)[1:32] AS hash FROM {URLS}",
    "tracking_param_counts": f"SELECT p.k AS k, {TRACKED.format('p.k')} AS tracking, count(*) AS n FROM (SELECT unnest({PAIRS}) AS p FROM pages) GROUP BY ALL",
    "url_first_wins": f"SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) = 1 AS is_first FROM {URLS}",
    "category_from_url": f"SELECT page_id, {FROM_URL} AS category FROM pages",
    "canonical_category": f"SELECT page_id, raw, {CATEGORY} AS category FROM (SELECT page_id, {FROM_URL} AS raw FROM pages)",
    "rfc2822_dates": f"SELECT event_id, strftime(date_trunc('second', ts) - to_minutes(({list(ZONES.values())})[user_id % {len(ZONES)} + 1]), '%Y-%m-%d %H:%M:%S') AS utc FROM events",
    "crawl_discovered": f"""
        WITH u AS (SELECT p.page_id, c.url, ({NAMES})[p.page_id % 7 + 1] AS source, p.page_id % 7 AS pos FROM pages p JOIN {URLS} c USING (page_id)),
        f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos, page_id) = 1 AS is_first, min(page_id) OVER (PARTITION BY url) AS i FROM u)
        SELECT source, count(*) AS discovered, count(*) FILTER (WHERE is_first AND i % 10 <> 9) AS fetched, count(*) FILTER (WHERE is_first AND i % 10 = 9) AS fetch_failed FROM f GROUP BY source""",
    "events_dedupe": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
}
