"""Landed API pages as DataFrames.

Each page is parsed with a declared schema whose post elements are kept as raw JSON text
first (Spark's JSON reader stores an object as its text when the schema says STRING).
The raw text is what tells a ``"retweeted_status": null`` key apart from a missing key
(P5); the nested fields are then parsed once with ``from_json``.  Arrival order is kept
as data: ``page_pos`` within a page and the newest-first id order (L4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import api_time
from ..operators.filters import has_json_key

USER_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("id_str", T.StringType()),
    T.StructField("screen_name", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("followers_count", T.LongType()),
])
POST_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("id_str", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("full_text", T.StringType()),
    T.StructField("retweet_count", T.LongType()), T.StructField("favorite_count", T.LongType()),
    T.StructField("lang", T.StringType()), T.StructField("in_reply_to_status_id", T.LongType()),
    T.StructField("user", USER_SCHEMA),
])
RETWEETER_SCHEMA = T.StructType([T.StructField("user", USER_SCHEMA)])

# Page shapes: search pages wrap posts in "statuses", timelines and retweeter lists are
# bare arrays, list-member pages wrap users in "users".
SHAPES = {
    "search": T.StructType([T.StructField("statuses", T.ArrayType(T.StringType()))]),
    "timeline": T.ArrayType(T.StringType()),
    "retweeters": T.ArrayType(T.StringType()),
    "list": T.StructType([T.StructField("users", T.ArrayType(T.StringType()))]),
}


def _elements(page: Column, shape: str) -> Column:
    parsed = F.from_json(page, SHAPES[shape])
    if shape == "search":
        return parsed["statuses"]
    if shape == "list":
        return parsed["users"]
    return parsed


def explode_pages(pages: DataFrame, page_col: str, shape: str, keep=()) -> DataFrame:
    """Page text -> one row per element with its position (``page_pos``) and raw JSON."""
    return (pages.select(*keep, F.posexplode_outer(_elements(F.col(page_col), shape)).alias("page_pos", "raw"))
                 .filter(F.col("page_pos").isNotNull()))


def read_pages(spark: SparkSession, path: str, shape: str, whole_files: bool = False) -> DataFrame:
    """S1-S4 reader: one page per line (default) or one page per file (``whole_files``,
    for pretty-printed pages).  A file is one API response, so whole-file rows stay
    small."""
    text = spark.read.text(path, wholetext=whole_files)
    text = text.select(F.col("value").alias("page"), F.col("_metadata.file_path").alias("src_file"))
    return explode_pages(text, "page", shape, keep=["src_file"])


def flatten_posts(df: DataFrame, raw_col: str = "raw", keep=()) -> DataFrame:
    """Raw post JSON -> canonical flat post row (``full_text`` when present).  Arrival
    order and provenance stay with the row: ``page_pos`` and ``src_file`` are kept when the
    input has them, and the time text as it came is ``created_at_raw``."""
    p = F.from_json(F.col(raw_col), POST_SCHEMA)
    keep = [*keep, *[c for c in ("src_file", "page_pos") if c in df.columns and c not in keep]]
    return df.select(
        *keep,
        F.coalesce(p["id"], p["id_str"].cast("bigint")).alias("tweet_id"),
        F.coalesce(p["user"]["id_str"].cast("bigint"), p["user"]["id"]).alias("user_id"),
        p["user"]["screen_name"].alias("screen_name"),
        p["user"]["name"].alias("user_name"),
        p["user"]["followers_count"].alias("followers"),
        p["retweet_count"].alias("retweets"),
        p["favorite_count"].alias("favorites"),
        api_time(p["created_at"]).alias("created_at"),
        p["created_at"].alias("created_at_raw"),
        F.coalesce(p["full_text"], p["text"]).alias("text"),
        p["lang"].alias("lang"),
        p["in_reply_to_status_id"].isNotNull().alias("is_reply"),
        has_json_key(F.col(raw_col), "retweeted_status").alias("is_retweet"),
    )


def flatten_users(df: DataFrame, raw_col: str = "raw", keep=()) -> DataFrame:
    """S3: list-member page elements -> (user_id, screen_name, user_name)."""
    u = F.from_json(F.col(raw_col), USER_SCHEMA)
    return df.select(*keep, F.coalesce(u["id"], u["id_str"].cast("bigint")).alias("user_id"),
                     u["screen_name"].alias("screen_name"), u["name"].alias("user_name"))


def flatten_retweeters(df: DataFrame, raw_col: str = "raw", keep=()) -> DataFrame:
    """Retweet elements -> the retweeting user."""
    u = F.from_json(F.col(raw_col), RETWEETER_SCHEMA)["user"]
    return df.select(*keep, u["id_str"].cast("bigint").alias("user_id"),
                     u["name"].alias("user_name"), u["screen_name"].alias("screen_name"))
