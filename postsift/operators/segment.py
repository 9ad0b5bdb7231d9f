"""Per-user segmentation (A3, A4, M6, S15): one grouped pass over all users' scored
posts replaces the reference's per-file loop."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .aggregate import share_expr
from .filters import is_measurable, is_target

# Routing thresholds and the four output table names of the reference
# (spelled as the reference writes them).
SHARE_THRESHOLD = 0.42
INFLUENCER_FOLLOWERS = 5000
LIFESTYLE_FOLLOWERS = 3000
SEGMENTS = ["beauty_infulencer", "beauty_account", "lifestyle_account", "ordinaly_account"]


def route(share: Column, followers: Column, threshold: float = SHARE_THRESHOLD,
          high: int = INFLUENCER_FOLLOWERS, low: int = LIFESTYLE_FOLLOWERS) -> Column:
    """M6: share >= threshold -> (followers >= high ? influencer : account), else
    (followers >= low ? lifestyle : ordinary).  NULL share or followers take the
    lower branch."""
    upper = F.coalesce(share >= F.lit(threshold), F.lit(False))
    return (F.when(upper & F.coalesce(followers >= F.lit(high), F.lit(False)), SEGMENTS[0])
             .when(upper, SEGMENTS[1])
             .when(F.coalesce(followers >= F.lit(low), F.lit(False)), SEGMENTS[2])
             .otherwise(SEGMENTS[3]))


def segment_users(scored: DataFrame, user_key: str, newest: Sequence[str], first_attrs: Sequence[str],
                  target: str, followers_col: str, pred_col: str = "prediction",
                  id_col: str = "tweet_id") -> DataFrame:
    """A3 + A4 + M6 in one aggregation per user.

    The first-row attributes are those of the newest post, which leads a user's file: a
    ``max_by`` over ``newest`` (columns that grow with time, such as the id).  The share
    counts are conditional counts.  All three are
    partial aggregates, so a user with a third of all posts is reduced map-side."""
    pred = F.col(pred_col)
    first = F.max_by(F.struct(*[F.col(c) for c in first_attrs]), F.struct(*[F.col(c) for c in newest]))
    g = scored.groupBy(user_key).agg(
        first.alias("_first"),
        F.count_if(is_target(pred, target)).alias("n_target"),
        F.count(F.when(is_measurable(pred), F.col(id_col))).alias("n_measurable"),
        F.count(F.lit(1)).alias("n_posts"))
    g = g.select(user_key, *[F.col(f"_first.{c}").alias(c) for c in first_attrs],
                 "n_target", "n_measurable", "n_posts",
                 share_expr(F.col("n_target"), F.col("n_measurable")).alias("target_share"))
    return g.withColumn("segment", route(F.col("target_share"), F.col(followers_col)))


def segment_frame(spark: SparkSession) -> DataFrame:
    """The four segments as a dimension (S15: every segment exists even when empty)."""
    return spark.createDataFrame([(s,) for s in SEGMENTS], T.StructType([T.StructField("segment", T.StringType())]))


def segment_counts(spark: SparkSession, segmented: DataFrame) -> DataFrame:
    """Users per segment including empty segments (dimension left join of a
    four-row aggregate; both sides are bounded by the number of segments)."""
    counts = segmented.groupBy("segment").agg(F.count(F.lit(1)).alias("n_users"))
    return (segment_frame(spark).join(F.broadcast(counts), "segment", "left")
            .select("segment", F.coalesce(F.col("n_users"), F.lit(0)).cast("bigint").alias("n_users")))
