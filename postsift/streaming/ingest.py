"""Incremental ingest of landed post pages (S16) on Structured Streaming.

The reference pages backwards through a search with a ``max_id`` cursor until an empty
page and drops retweets on the way.  Here landed files are a file-source stream run
with ``trigger(availableNow=True)`` (every file present is processed, in bounded
micro-batches, then the query stops); repeated ids are dropped exactly
(``dropDuplicates`` on the id: the state holds one key per id and lives in the
checkpointed state store), or — when landings arrive in event-time order — with state
bounded by an event-time watermark (``exact=False``: ``dropDuplicatesWithinWatermark``,
which treats rows older than the watermark as late and drops them).  The file sink + checkpoint make reruns exactly-once, and a lost
executor only re-runs its micro-batch tasks.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_scratch, scratch_path
from ..sources import json_posts
from .cursor import cursor_stream


def dedup_stream(stream: DataFrame, key: str, time_col: str, delay: str = "1 day", exact: bool = True) -> DataFrame:
    if exact:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, out_path: str, ckpt_path: str, fmt: str = "parquet", one_batch: bool = False) -> None:
    trigger = {"once": True} if one_batch else {"availableNow": True}
    q = (stream.writeStream.format(fmt).option("path", out_path).option("checkpointLocation", ckpt_path)
         .outputMode("append").trigger(**trigger).start())
    q.awaitTermination()


def high_water_mark(df: DataFrame, id_col: str, max_id: int | None) -> DataFrame:
    """Batch twin of the cursor: rows at or below ``max_id`` (all when None)."""
    return df if max_id is None else df.filter(F.col(id_col) <= F.lit(max_id))


# The state of the exact de-duplication is one key per id; RocksDB keeps it on disk.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's setting is back after."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def follow_searches(spark: SparkSession, land: str, schema: str, out: str, ckpt: str, total: int = 0,
                    files_per_trigger: int = 100, ttl_ms: int | None = None) -> DataFrame:
    """S16 + W2: takes what has landed under ``land`` (Parquet files of search, seq, page) since
    the last call with this ``ckpt`` and appends the taken posts to ``out``.  Returns ``out``.
    With ``ttl_ms`` a call is one micro-batch: state by processing time always asks for
    another batch, so ``availableNow`` would not end."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(land)
    posts = cursor_stream(pages, total, ttl_ms)
    with rocksdb_state(spark):
        run_available(posts, out, ckpt, one_batch=ttl_ms is not None)
    return spark.read.schema(posts.schema).parquet(out)


def ingest_pages(spark: SparkSession, land: str, shape: str = "search", files_per_trigger: int = 100,
                 delay: str = "1 day", exact: bool = True) -> DataFrame:
    """Stream landed pages (one JSON page per line under ``land``): posts are flattened,
    retweets are dropped on the way, ids that pages repeat are kept once.  Returns what the
    sink holds."""
    pages = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(land)
    posts = json_posts.flatten_posts(json_posts.explode_pages(pages.withColumnRenamed("value", "page"), "page", shape))
    posts = posts.filter(~F.col("is_retweet")).drop("page_pos").withColumn("event_time", F.col("created_at").cast("timestamp"))
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    with rocksdb_state(spark):
        run_available(dedup_stream(posts, "tweet_id", "event_time", delay, exact), out, ck)
    remove_scratch(spark, ck)
    return spark.read.schema(posts.schema).parquet(out).drop("event_time")
