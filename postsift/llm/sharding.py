"""Sharding by rendezvous hashing of stable record keys (operator 2).

Each shard scores a key with -weight / ln(u), u being a uniform number in (0, 1) hashed
from key and shard; the highest score wins (the lowest shard on ties).  A shard's score
does not depend on the other shards, so one more shard takes records only into itself,
and a share of weight / total weight of the keys goes to each.

Slots number the records of a shard without gaps.  A shard is cut into buckets by a hash
of the record; the bucket sizes (shards x buckets rows, a fixed number) give each bucket's
first slot, and records are numbered inside their buckets, so no shard meets in one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256        # parts of a shard that are numbered on their own


def _key(cols: Sequence[str]) -> Column:
    """A stable text key: every column as text with its length, nulls marked."""
    return F.concat_ws(",", *[F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
                              for c in cols])


def uniform(h: Column) -> Column:
    """A number in (0, 1) from a 64-bit hash: 52 bits and a half, which a double holds exactly, so
    that neither end is reached."""
    return (F.shiftrightunsigned(h, 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def shard_of(keys: Sequence[str], weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) of a record by its key columns; all weights must be > 0."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    key = F.xxhash64(_key(keys))
    scores = []
    for shard, weight in enumerate(weights):
        u = uniform(F.xxhash64(key, F.lit(shard)))
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("least")))
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return -best["least"]


def shard(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text",
          more_weights: Sequence[float] = (), buckets: int = BUCKETS) -> DataFrame:
    """id_col, size (UTF-8 bytes of the text and 16), text_crc32, shard, slot, grown_shard
    (the shard when shards of ``more_weights`` are added; null without).

    Null text: no bytes, crc32 of nothing (0).  A null id is a key like any other.  Repeated
    rows go to one shard and get a slot each.  Other columns are ignored; an empty table
    gives an empty result."""
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(data) + 16).cast("long").alias("size"),
                       F.crc32(data).alias("text_crc32"))
    grown = shard_of(["id"], [*weights, *more_weights]) if more_weights else F.lit(None).cast("int")
    rows = rows.select("*", shard_of(["id"], weights).alias("shard"), grown.alias("grown_shard"),
                       F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(buckets)).cast("int").alias("bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    out = rows.withColumn("nth", F.row_number().over(inside)).join(firsts, ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard",
                      (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard")
