"""RFC 2822 dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{2}|\d{4})\s+(\d{1,2}:\d{2})(?::(\d{2}))?\s*(\S+)?\s*$"
# Hours of the named zones of the standard.
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}


def to_utc(raw: Column) -> Column:
    """A timestamp of an RFC 2822 date; other forms, ISO 8601 too, give null. No zone and -0000 mean UTC."""
    part = lambda k: F.regexp_extract(raw, SHAPE, k)
    year = F.when(F.length(part(3)) == 2, F.concat(F.when(part(3) < "69", "20").otherwise("19"), part(3))).otherwise(part(3))
    zone = F.upper(part(6))
    offset = F.when(zone.rlike(r"^[+-]\d{4}$"), zone)
    for name, hours in ZONES.items():
        offset = offset.when(zone == name, f"{'-' if hours < 0 else '+'}{abs(hours):02d}00")
    text = F.concat_ws(" ", part(1), F.initcap(part(2)), year, F.concat(part(4), F.lit(":"), F.coalesce(F.nullif(part(5), F.lit("")), F.lit("00"))), offset.otherwise("+0000"))
    return F.when(part(1) != "", F.try_to_timestamp(text, F.lit("d MMM yyyy H:mm:ss Z")))
