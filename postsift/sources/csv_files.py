"""CSV tables with declared schemas (S6-S8, N3) and the header alias map.

Python's csv writer (the reference's) ends rows with CRLF and quotes fields holding
newlines; Spark's ``multiLine`` reader with ``lineSep='\\r\\n'`` reads such files exactly
(embedded ``\\n`` and ``\\r\\n`` kept).  Files written by Spark itself use LF rows (Spark's
CRLF writer rewrites embedded ``\\n``) and are read back exactly with the default line
handling (``line_sep=None``).  Multi-line CSV files cannot be split, so land them once to
Parquet and work from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# On-disk (Japanese) headers of the reference's tables -> canonical names.
HEADER_ALIASES = {
    "ユーザーid": "user_id", "スクリーンネーム": "screen_name", "ユーザー名": "user_name",
    "フォロワー数": "followers", "リツイート数": "retweets", "ファボ数": "favorites",
    "投稿日時": "created_at", "ツイート内容": "text", "Tweet_id": "tweet_id", "時間": "created_at_raw",
    "ユーザーネーム": "user_name", "リツイート元url": "post_url", "予想": "prediction",
    "美容系ツイート率": "target_share",
}
# An unquoted empty field is NULL and a quoted one the empty string; Spark tells them apart
# only if its mark for NULL is not the empty string itself.
NULL_MARK = "\u0001NULL\u0001"

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"',
               "encoding": "UTF-8", "recursiveFileLookup": "false", "nullValue": NULL_MARK, "mode": "FAILFAST"}


def canonical_names(df: DataFrame) -> DataFrame:
    """Rename on-disk headers to canonical names."""
    return df.select(*[F.col(f"`{c}`").alias(HEADER_ALIASES.get(c, c)) for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.csv",
             with_file: bool = True, line_sep: str | None = "\r\n") -> DataFrame:
    """S6 + S7: header CSV files under ``path`` matching ``glob`` (non-recursive), read
    with a declared schema.  The words NA / null stay text (N3).  A directory that
    `write_csv` partitioned gives its partition columns with their values; ``src_file`` is
    the name of the file a row came from."""
    r = spark.read.options(**CSV_OPTIONS).option("pathGlobFilter", glob).schema(schema)
    if line_sep:
        r = r.option("lineSep", line_sep)
    df = r.csv(path)
    if with_file:
        df = df.withColumn("src_file", F.col("_metadata.file_name"))
    return df


def key_from_file(name_col: Column | str) -> Column:
    """The key that a file stands for: its name without ``.csv``.  Spark gives file names
    with %-escapes, which are undone; a ``+`` is a plus sign."""
    c = F.col(name_col) if isinstance(name_col, str) else name_col
    return F.url_decode(F.replace(F.regexp_extract(c, r"([^/]*)\.csv$", 1), F.lit("+"), F.lit("%2B")))


def cluster_for_write(df: DataFrame, keys) -> DataFrame:
    """Rows of a key brought together before a ``partitionBy`` write.

    Unclustered, every task writes one file per key it holds (tasks x keys files).  The
    ``rebalance`` hint lets AQE size the tasks: small ones are merged, and a key that holds a
    third of the rows is split over several."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.hint("rebalance", *[F.col(k) for k in keys])


def write_csv(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Header CSV (LF rows, read back with ``line_sep=None``); one directory
    per key with ``partition_by``; ``overwrite`` replaces previous outputs (static
    overwrite).  Text comes back as it was, white space at its ends too; NULL is an empty
    field, the empty string a quoted one."""
    if partition_by:
        df = cluster_for_write(df, partition_by)
    w = df.write.mode(mode).options(header="true", escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.csv(path)
