"""Text expressions: normalisation, words, sentences, numbers and names.

Python's white space has four code points that Java's lacks, hence the explicit class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
# What starts a line of boilerplate; characters that start a Vietnamese name.
BOILERPLATE = ("đọc thêm", "doc them", "xem thêm", "xem them", "tags?:", "từ khóa:", "tu khoa:", "liên quan:", "lien quan:", "chia sẻ", "chia se")
CAPITALS = "A-ZĐÁÀẢÃẠÂẤẦẨẪẬĂẮẰẲẴẶÉÈẺẼẸÊẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÚÙỦŨỤƯỨỪỬỮỰÝỲỶỸỴ"
NAME = f"[{CAPITALS}][\\p{{L}}\\p{{N}}_À-ỹ]*"


def nfc(text: Column) -> Column:
    """Unicode normal form C, by the ICU that Spark brings along for its collations; no text goes to Python."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.isNotNull(), composed)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def is_boilerplate(line: Column) -> Column:
    """Whether a line starts as one that leads elsewhere does."""
    return line.rlike(f"(?imdU)^{SPACE}*(?:{'|'.join(BOILERPLATE)})")


def clean_text(text: Column) -> Column:
    """normalize_text() of text that is in normal form C already."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), f"(?imdU)^{SPACE}*(?:{'|'.join(BOILERPLATE)}).*$", "")
    return F.trim(F.regexp_replace(kept, f"(?U){SPACE}+", " "))


def normalize_text(text: Column) -> Column:
    """Normal form C, boilerplate lines gone, white space collapsed; null gives ''."""
    return clean_text(nfc(F.coalesce(text, F.lit(""))))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def sentences(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?…])[\s\x1c-\x1f]+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def numerics(text: Column) -> Column:
    """Runs without white space that hold a digit, stripped of marks; repeats stay."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)[^\s\x1c-\x1f]*\d[^\s\x1c-\x1f]*"), 0)
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"^[.,;:%()\[\]{}]+|[.,;:%()\[\]{}]+$", "")), lambda x: x != "")


def entities(text: Column) -> Column:
    """Two or more capitalised words in a row, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){NAME}(?:{SPACE}+{NAME})+"), 0)
    return F.array_distinct(F.transform(found, strip))


def collapse_marks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f\-–—.,;:()\[\]{}/]+", " "))


def contains_numeric(source: Column, token: Column) -> Column:
    """The token, or it without marks, or all its groups of three digits and more, lie in the source."""
    groups = F.regexp_extract_all(token, F.lit(r"(?U)\d{3,}"), 0)
    plain = collapse_marks(token)
    return F.contains(source, token) | ((plain != "") & F.contains(collapse_marks(source), plain)) | ((F.size(groups) > 0) & F.forall(groups, lambda g: F.contains(source, g)))


def contains_entity(source: Column, entity: Column) -> Column:
    """The name, or it without marks, or one of its words of four letters and more, lies in the source."""
    plain = collapse_marks(entity)
    parts = F.split(entity, f"(?U){SPACE}+")
    return F.contains(source, entity) | ((plain != "") & F.contains(collapse_marks(source), plain)) | F.exists(parts, lambda w: (F.length(w) >= 4) & F.contains(source, w))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
