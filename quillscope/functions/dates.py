"""Times as text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_seconds(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stored_utc(text: Column) -> Column:
    """A stored time without zone as ISO text in UTC; empty is null."""
    t = F.when(text.contains("T"), text).otherwise(F.regexp_replace(text, "^([^ ]*) ", "$1T"))
    return F.when(F.length(text) > 0, F.when(t.endswith("Z"), t).otherwise(F.concat(t, F.lit("Z"))))


def local_time(at: Column, zone: str = "America/Chicago") -> Column:
    """A time (UTC) for readers in a zone, with the zone's short name."""
    here = F.from_utc_timestamp(at, zone)
    ahead = (F.unix_seconds(here) - F.unix_seconds(at.cast("timestamp"))) / 3600
    name = F.when(ahead == -5, "CDT").otherwise("CST") if zone == "America/Chicago" else F.lit(zone)
    return F.concat(F.date_format(here, "MMM d, yyyy, h:mm:ss a"), F.lit(" "), name)


def pdf_date(raw: Column) -> Column:
    """A date like D:20240115120000+05'30' as ISO text; what isn't one stays."""
    digits = F.regexp_extract(F.regexp_replace(raw, "^D:", ""), r"^(\d{4}(?:\d{2}){0,5})", 1)
    part = lambda at, unset: F.coalesce(F.nullif(F.substring(digits, at, 2), F.lit("")), F.lit(unset))
    text = F.concat(F.substring(digits, 1, 4), F.lit("-"), part(5, "01"), F.lit("-"), part(7, "01"), F.lit(" "), part(9, "00"), F.lit(":"), part(11, "00"), F.lit(":"), part(13, "00"))
    at = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(digits == "", raw).otherwise(F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'.000Z'"), raw))
