"""URL expressions: canonical form, hash, category."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that start so are dropped.
TRACKING = ("utm_", "ga_", "yclid", "fbclid", "gclid", "mc_cid", "mc_eid", "vero_", "_ga", "ref", "ref_src", "ref_url", "spm", "share_source", "from", "src")
# Categories with their aliases, in order of precedence.
CATEGORIES = {
    "thoi_su": ("thời sự", "thoi su", "thoi-su", "thoi_su", "xã hội", "xa-hoi", "xa_hoi", "xa hoi"),
    "kinh_doanh": ("kinh doanh", "kinh-doanh", "kinh_doanh", "kinh tế", "kinh-te", "kinh_te", "kinh te"),
    "cong_nghe": ("công nghệ", "cong nghe", "cong-nghe", "cong_nghe", "so-hoa", "so_hoa", "khoa-hoc", "khoa_hoc"),
    "the_thao": ("thể thao", "the thao", "the-thao", "the_thao"),
    "giai_tri": ("giải trí", "giai tri", "giai-tri", "giai_tri", "van-hoa-giai-tri", "van_hoa_giai_tri"),
    "giao_duc": ("giáo dục", "giao duc", "giao-duc", "giao_duc", "giao-duc-huong-nghiep", "giao_duc_huong_nghiep"),
    "suc_khoe": ("sức khỏe", "suc khoe", "suc-khoe", "suc_khoe"),
    "the_gioi": ("thế giới", "the gioi", "the-gioi", "the_gioi"),
}
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?s:#.*)?$"


def decoded(x: Column) -> Column:
    """Percent-decoding that leaves what is no escape as it is."""
    return F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))


def encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(query: Column) -> Column:
    """array<struct<k, v>> of a query's pairs that have a value."""
    parts = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=.+$"))
    return F.transform(parts, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.regexp_replace(p, "(?s)^[^=]*=", "")).alias("v")))


def is_tracking(key: Column) -> Column:
    return F.lower(key).rlike(f"^(?:{'|'.join(TRACKING)})")


def canonicalize_url(url: Column) -> Column:
    """Lower-case scheme (https if there is none) and host, no default port, no tracking or empty
    parameters, the rest sorted, single slashes, no trailing slash but the root's, no fragment."""
    # Leading control characters, and tabs and line ends anywhere, are no part of a URL.
    url = F.regexp_replace(url, r"(?U)^[\s\x00-\x1f]+|[\s\x1c-\x1f]+$|[\t\r\n]", "")
    part = lambda k: F.regexp_extract(url, PARTS, k)
    scheme = F.coalesce(F.nullif(F.lower(part(1)), F.lit("")), F.lit("https"))
    host = F.lower(part(2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.coalesce(F.nullif(part(3), F.lit("")), F.lit("/")), "/{2,}", "/")
    path = F.when(path != "/", F.regexp_replace(path, "/$", "")).otherwise(path)
    pairs = F.array_sort(F.filter(query_pairs(part(4)), lambda p: ~is_tracking(p["k"])))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(canonicalize_url(url), 256), 1, 32)


def category_from_url(url: Column) -> Column:
    """First path segment if another part follows it, as a key; else null."""
    return F.lower(F.replace(F.nullif(F.regexp_extract(url, r"(?U)^(?s:.*?)//[^/]*/(?:/)?([\p{L}\p{N}_\-]+)/", 1), F.lit("")), F.lit("-"), F.lit("_")))


def canonical_category(raw: Column) -> Column:
    """The first category one of whose aliases lies in the text or holds it; else null."""
    needle = F.lower(raw)
    out = F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None).cast("string"))
    for key, aliases in CATEGORIES.items():
        hit = F.lit(False)
        for a in aliases:
            hit = hit | F.contains(needle, F.lit(a)) | F.contains(F.lit(a), needle)
        out = out.when(hit, key)
    return out
