"""Time, count and link parsing (F37-F40).  All built-in expressions; the session time
zone never matters because parsing goes through TIMESTAMP_NTZ with explicit zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_tags

# Text formats of the sources and of the output.
API_TIME_FORMAT = "EEE MMM dd HH:mm:ss '+0000' yyyy"     # e.g. Wed Aug 27 13:08:45 +0000 2008
API_TIME_PARSE = "MMM dd HH:mm:ss '+0000' yyyy"          # day name skipped: 'E' cannot be parsed
SCRAPE_TIME_FORMAT = "H:mm - yyyy年M月d日"                  # e.g. 9:05 - 2019年3月7日
OUTPUT_MINUTE_FORMAT = "yyyy-MM-dd HH:mm"
LIKE_SUFFIX = " いいね"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def api_time(c) -> Column:
    """F37 parse: API text (always UTC) -> TIMESTAMP_NTZ wall clock in UTC."""
    c = _c(c)
    return F.to_timestamp_ntz(F.substr(c, F.lit(5)), F.lit(API_TIME_PARSE))


def api_time_text(ts) -> Column:
    """Inverse of `api_time` for a UTC wall-clock timestamp."""
    return F.date_format(_c(ts), API_TIME_FORMAT)


def local_minute(ts_utc_ntz, zone: str) -> Column:
    """F37 render: UTC wall clock -> 'yyyy-MM-dd HH:mm' in ``zone``."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(ts_utc_ntz)), OUTPUT_MINUTE_FORMAT)


def api_time_to_local_minute(c, zone: str) -> Column:
    """``YmdHMS(created_at)``."""
    return local_minute(api_time(c), zone)


def scrape_time(c) -> Column:
    """F38 parse: 'H:mm - yyyy年M月d日' (1-2 digit fields, no zone) -> TIMESTAMP_NTZ."""
    return F.to_timestamp_ntz(_c(c), F.lit(SCRAPE_TIME_FORMAT))


def scrape_time_text(ts) -> Column:
    return F.date_format(_c(ts), SCRAPE_TIME_FORMAT)


def scrape_time_to_minute(c) -> Column:
    """``YmdHMS`` of the scraper."""
    return F.date_format(scrape_time(c), OUTPUT_MINUTE_FORMAT)


def count_text_to_long(c) -> Column:
    """F39 + N2: '<span>1,234 いいね</span>' -> 1234 (NULL when not a number)."""
    t = F.replace(F.replace(strip_tags(_c(c)), F.lit(LIKE_SUFFIX), F.lit("")), F.lit(","), F.lit(""))
    return t.try_cast("bigint")


def first_path_segment(c) -> Column:
    """the first '/x/' segment of a link (NULL when there is none)."""
    c = _c(c)
    return F.when(c.rlike("/[^/]*/"), F.regexp_extract(c, "/([^/]*)/", 1))
