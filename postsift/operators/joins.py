"""Joins that the reference runs as nested loops.

No side is broadcast by hint: every data-derived side is left to Catalyst + AQE, which
broadcast it only after measuring it under ``spark.sql.autoBroadcastJoinThreshold`` and
otherwise sort-merge join, splitting skewed partitions
(``spark.sql.adaptive.skewJoin.enabled``).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import LABEL_PREFIX, post_link

# The reference's weak-labelling dictionary (category -> search keywords).
REFERENCE_KEYWORDS = {
    "IT": ["テスト駆動", "講演", "dev", "参考書", "GKE", "パターンマッチ", "メモリ"],
    "美容": ["アクアレーベル", "雪肌精", "透明肌"],
    "暮らし": ["猫", "酒場", "英国式パブ", "一杯", "カクテル"],
    "エンタメ": ["プラチナメダル", "勝った", "ワタナベ楽器", "ストラップ", "ケーブル", "ステッカー",
              "アンデッド", "パスカット", "ドリブル", "キャプテン", "ユニフォーム", "禁忌", "猫耳",
              "ティターン", "OPTIWEB"],
}

MAX_LITERAL_KEYWORDS = 10_000     # entries of a dictionary that is part of the plan
ANCHOR = 3                        # characters of a keyword that a post is looked up by


def keyword_frame(spark: SparkSession, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    """(category, keyword) rows of a category -> keywords mapping."""
    rows = [(c, k) for c, kws in mapping.items() for k in kws]
    schema = T.StructType([T.StructField("category", T.StringType()), T.StructField("keyword", T.StringType())])
    return spark.createDataFrame(rows, schema)


def keyword_label(posts: DataFrame, mapping: Mapping[str, Sequence[str]], text_col: str = "text") -> DataFrame:
    """J1 + P13: every (post, category, keyword) whose text contains the keyword.

    A post matching several keywords appears once per keyword, as in the reference's
    per-keyword searches.  The dictionary (a literal of at most ``MAX_LITERAL_KEYWORDS``
    entries; use `keyword_join` for a table of keywords) is part of the projection: each post
    is tested in place, with no join and no shuffle."""
    pairs = [(c, k) for c, kws in mapping.items() for k in kws]
    if len(pairs) > MAX_LITERAL_KEYWORDS:
        raise ValueError("use keyword_join for a table of keywords")
    kind = "array<struct<category:string,keyword:string>>"
    words = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("keyword")) for c, k in pairs]).cast(kind)
    hits = F.filter(words, lambda w: F.col(text_col).contains(w["keyword"]))
    out = posts.select("*", F.explode_outer(hits).alias("_kw")).filter(F.col("_kw").isNotNull())
    return _labelled(out.select(*posts.columns, "_kw.category", "_kw.keyword"))


def keyword_join(posts: DataFrame, keywords: DataFrame, text_col: str = "text") -> DataFrame:
    """J1 for a table (category, keyword) of any size, in one pass over the posts.

    A keyword is found by its first ``ANCHOR`` characters: the distinct character n-grams of
    a post are joined to them (an equi-join that AQE splits when an anchor is hot), and what
    meets is tested with ``contains``.  Shorter keywords are looked up by all their
    characters.  An empty keyword is contained in every text and is left out."""
    text = F.col(text_col)
    keywords = keywords.filter(F.length("keyword") > 0).distinct()

    def grams(n):
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))

    looked = posts.select("*", F.explode_outer(F.array_distinct(F.concat(*map(grams, range(1, ANCHOR + 1))))).alias("_anchor")).filter(F.col("_anchor").isNotNull())
    kw = keywords.select("category", "keyword", F.substr("keyword", F.lit(1), F.least(F.length("keyword"), F.lit(ANCHOR))).alias("_anchor"))
    j = looked.join(kw, "_anchor").filter(text.contains(F.col("keyword")))
    return _labelled(j.select(*posts.columns, "category", "keyword"))


def _labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.concat(F.lit(LABEL_PREFIX), F.col("category")))


def user_timeline(posts: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """J2 + P12: posts of listed users (inner equi-join: unknown users yield no rows)."""
    return posts.join(users, key, "inner")


def unresolved_users(users: DataFrame, posts: DataFrame, key: str) -> DataFrame:
    """P12 report: listed users with no posts (anti-join)."""
    return users.join(posts.select(key), key, "left_anti")


def retweeter_edges(parents: DataFrame, retweets: DataFrame, key: str, parent_name_col: str,
                    parent_id_col: str) -> DataFrame:
    """Parent post -> each retweeting user (1 -> N inner) with the parent's link."""
    j = parents.join(retweets, key, "inner")
    return j.withColumn("post_url", post_link(F.col(parent_name_col), F.col(parent_id_col)))


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key survives (left semi-join; a hot key is split by AQE)."""
    return df.join(keys.select(key), key, "left_semi")
