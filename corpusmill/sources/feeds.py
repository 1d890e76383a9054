"""The configured news sources and their feeds, and feed documents as rows."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from html import escape, unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The configured sources and their feeds.
SOURCES = (
    ("vnexpress", "VnExpress", "vnexpress.net", True, None, (
        "https://vnexpress.net/rss/tin-moi-nhat.rss",
        "https://vnexpress.net/rss/thoi-su.rss",
        "https://vnexpress.net/rss/kinh-doanh.rss",
        "https://vnexpress.net/rss/so-hoa.rss",
        "https://vnexpress.net/rss/the-thao.rss",
        "https://vnexpress.net/rss/giai-tri.rss",
        "https://vnexpress.net/rss/giao-duc.rss",
        "https://vnexpress.net/rss/khoa-hoc.rss",
        "https://vnexpress.net/rss/suc-khoe.rss",
    )),
    ("tuoitre", "Tuoi Tre Online", "tuoitre.vn", True, None, (
        "https://tuoitre.vn/rss/tin-moi-nhat.rss",
        "https://tuoitre.vn/rss/thoi-su.rss",
        "https://tuoitre.vn/rss/kinh-doanh.rss",
        "https://tuoitre.vn/rss/cong-nghe.rss",
        "https://tuoitre.vn/rss/the-thao.rss",
        "https://tuoitre.vn/rss/giai-tri.rss",
        "https://tuoitre.vn/rss/giao-duc.rss",
        "https://tuoitre.vn/rss/suc-khoe.rss",
    )),
    ("thanhnien", "Thanh Nien", "thanhnien.vn", True, None, (
        "https://thanhnien.vn/rss/home.rss",
        "https://thanhnien.vn/rss/thoi-su.rss",
        "https://thanhnien.vn/rss/kinh-te.rss",
        "https://thanhnien.vn/rss/cong-nghe.rss",
        "https://thanhnien.vn/rss/the-thao.rss",
        "https://thanhnien.vn/rss/giai-tri.rss",
        "https://thanhnien.vn/rss/giao-duc.rss",
        "https://thanhnien.vn/rss/suc-khoe.rss",
    )),
    ("vietnamnet", "VietnamNet", "vietnamnet.vn", True, 100, (
        "https://vietnamnet.vn/rss/thoi-su.rss",
        "https://vietnamnet.vn/rss/kinh-doanh.rss",
        "https://vietnamnet.vn/rss/cong-nghe.rss",
        "https://vietnamnet.vn/rss/the-thao.rss",
        "https://vietnamnet.vn/rss/giai-tri.rss",
        "https://vietnamnet.vn/rss/giao-duc.rss",
        "https://vietnamnet.vn/rss/suc-khoe.rss",
    )),
    ("dantri", "Dan Tri", "dantri.com.vn", True, None, (
        "https://dantri.com.vn/rss/home.rss",
        "https://dantri.com.vn/rss/xa-hoi.rss",
        "https://dantri.com.vn/rss/kinh-doanh.rss",
        "https://dantri.com.vn/rss/cong-nghe.rss",
        "https://dantri.com.vn/rss/the-thao.rss",
        "https://dantri.com.vn/rss/giai-tri.rss",
        "https://dantri.com.vn/rss/giao-duc-huong-nghiep.rss",
        "https://dantri.com.vn/rss/suc-khoe.rss",
    )),
    ("znews", "Znews", "znews.vn", True, None, (
        "https://znews.vn/rss/thoi-su.rss",
        "https://znews.vn/rss/xa-hoi.rss",
        "https://znews.vn/rss/cong-nghe.rss",
        "https://znews.vn/rss/the-thao.rss",
        "https://znews.vn/rss/giai-tri.rss",
        "https://znews.vn/rss/giao-duc.rss",
        "https://znews.vn/rss/suc-khoe.rss",
        "https://znews.vn/rss/the-gioi.rss",
    )),
    ("vtcnews", "VTC News", "vtcnews.vn", True, None, (
        "https://vtcnews.vn/rss/feed.rss",
        "https://vtcnews.vn/rss/thoi-su.rss",
        "https://vtcnews.vn/rss/kinh-te.rss",
        "https://vtcnews.vn/rss/cong-nghe.rss",
        "https://vtcnews.vn/rss/the-thao.rss",
        "https://vtcnews.vn/rss/giai-tri.rss",
    )),
    ("laodong", "Lao Dong", "laodong.vn", False, None, (
        "https://laodong.vn/rss/home.rss",
        "https://laodong.vn/rss/thoi-su.rss",
        "https://laodong.vn/rss/kinh-doanh.rss",
        "https://laodong.vn/rss/cong-nghe.rss",
        "https://laodong.vn/rss/the-thao.rss",
        "https://laodong.vn/rss/van-hoa-giai-tri.rss",
        "https://laodong.vn/rss/giao-duc.rss",
        "https://laodong.vn/rss/suc-khoe.rss",
    )),
)
SOURCE_SCHEMA = "source_pos int, id string, name string, domain string, rss array<string>, enabled boolean, max_items_per_feed int"
ENTRY_SCHEMA = "source string, feed_pos int, entry_pos int, link string, title string, published string, updated string, pubDate string, dc_date string, tags array<struct<term:string>>, author string"

ENTRY_TYPES = pa.schema([("source", pa.string()), ("feed_pos", pa.int32()), ("entry_pos", pa.int32()), *((c, pa.string()) for c in ("link", "title", "published", "updated", "pubDate", "dc_date")), ("tags", pa.list_(pa.struct([("term", pa.string())]))), ("author", pa.string())])


def sources(spark: SparkSession) -> DataFrame:
    """The source configuration as a relation, in order."""
    rows = [(k, i, name, domain, list(feeds), on, cap) for k, (i, name, domain, on, cap, feeds) in enumerate(SOURCES)]
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def enabled_sources(sources_df: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """Enabled sources, all or those named; naming a disabled one does not select it. An empty choice means all."""
    found = sources_df.where("enabled")
    return found.where(F.col("id").isin(*only)) if (only := list(only or ())) else found


def feed_urls(sources_df: DataFrame) -> DataFrame:
    """One row for each feed: source_pos, source, feed_pos, feed_url, max_items_per_feed."""
    return sources_df.select("source_pos", F.col("id").alias("source"), "max_items_per_feed", F.posexplode("rss").alias("feed_pos", "feed_url"))


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def elements(body: str | bytes) -> list[ET.Element]:
    """Finished item and entry elements of a document, in order; those before a fault if it has one."""
    text = body.decode("utf-8", "replace") if isinstance(body, bytes) else body
    # Names that HTML has and XML has not; an ampersand that begins none stands for itself.
    text = re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)(\w*;?)", lambda m: escape(unescape("&" + m[1])), text)
    parser, found = ET.XMLPullParser(["end"]), []
    try:
        parser.feed(re.sub(r"^\s*(?:<\?xml[^>]*\?>)?", "", text))
        parser.close()
    except ET.ParseError:
        pass
    # What was read before a fault is given out first, then the fault.
    try:
        for _, e in parser.read_events():
            if local(e.tag) in ("item", "entry"):
                found.append(e)
    except ET.ParseError:
        pass
    return found


def entries_of(body: str | bytes | None) -> list[dict]:
    """Entries of an RSS or Atom document; a malformed one has those before its fault."""
    out = []
    for item in elements(body or ""):
        e: dict = {"tags": []}
        for x in item:
            name, text = local(x.tag), (x.text or "").strip()
            if name == "link":
                e.setdefault("link", text or x.get("href"))
            elif name == "category":
                e["tags"].append({"term": text or x.get("term")})
            elif name in ("author", "creator"):
                e.setdefault("author", text or next((y.text for y in x if local(y.tag) == "name"), None))
            elif name in ("title", "published", "updated", "pubDate"):
                e.setdefault(name, text)
            elif name == "date":
                e.setdefault("dc_date", text)
        out.append(e)
    return out


def parse_feeds(bodies: DataFrame) -> DataFrame:
    """Entries of fetched feeds. bodies: source, feed_pos, body; null and malformed bodies have no entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"source": source, "feed_pos": feed, "entry_pos": k, **e} for source, feed, body in zip(*(c.to_pylist() for c in b.columns), strict=True) for k, e in enumerate(entries_of(body))]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in ENTRY_TYPES], schema=ENTRY_TYPES)

    return bodies.select("source", "feed_pos", "body").mapInArrow(run, ENTRY_SCHEMA)
