"""Article text of HTML pages."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusmill.functions.text import BOILERPLATE

MIN_WORDS = 50
SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "template", "svg"}
#: Elements that do not start a line of their own.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr"}
DATE_NAMES = {"article:published_time", "date", "dc.date", "pubdate", "publishdate"}
SPACE = re.compile(r"\s+")
BOILERPLATE_LINE = re.compile(rf"(?im)^\s*(?:{'|'.join(BOILERPLATE)}).*$")


def normalized(text: str) -> str:
    """What functions.text.normalize_text makes of a text."""
    return SPACE.sub(" ", BOILERPLATE_LINE.sub("", unicodedata.normalize("NFC", text))).strip()


class ArticleParser(HTMLParser):
    """Text inside <article>, text of the whole body, title, language, author and date."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.article: list[str] = []
        self.body: list[str] = []
        self.title: list[str] = []
        self.skip = self.in_article = self.in_title = 0
        self.language = self.author = self.published = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "html":
            self.language = a.get("lang") or self.language
        elif tag == "meta" and (a.get("name") or "").lower() == "author":
            self.author = a.get("content") or self.author
        elif tag == "meta" and (a.get("property") or a.get("name") or "").lower() in DATE_NAMES:
            self.published = self.published or a.get("content")
        self.skip += tag in SKIPPED
        self.in_article += tag == "article"
        self.in_title += tag == "title"
        if not self.skip:
            self.add(" " if tag in INLINE else "\n")

    def handle_endtag(self, tag: str) -> None:
        self.skip = max(0, self.skip - (tag in SKIPPED))
        self.in_article = max(0, self.in_article - (tag == "article"))
        self.in_title = max(0, self.in_title - (tag == "title"))
        if not self.skip:
            self.add(" " if tag in INLINE else "\n")

    def handle_data(self, data: str) -> None:
        self.add(SPACE.sub(" ", data))

    def add(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.body.append(data)
            if self.in_article:
                self.article.append(data)


def extract(html: str | None) -> dict:
    """title, author, published, language and content_text of a page.

    The text is the article's, normalised, if that has MIN_WORDS words, else the body's if that
    has, else null. Boilerplate lines are gone before words are counted.
    """
    p = ArticleParser()
    try:
        p.feed(html or "")
        p.close()
    except (AssertionError, ValueError):  # markup the parser gives up on
        pass
    texts = (normalized("".join(t)) for t in (p.article, p.body))
    found = next((t for t in texts if len(t.split()) >= MIN_WORDS), None)
    return {"title": SPACE.sub(" ", "".join(p.title)).strip() or None, "author": p.author, "published": p.published, "language": p.language, "content_text": found}


FIELDS = ("title", "author", "published", "language", "content_text")
EXTRACTED = StructType([StructField(c, StringType()) for c in FIELDS])


@F.pandas_udf(EXTRACTED)
def extract_html(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(h) for h in html], columns=FIELDS)
