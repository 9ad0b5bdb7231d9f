"""Row predicates and projections."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The measurable-prediction marker and the index-column name pattern.
LABEL_PREFIX = "__label__"
UNNAMED_PATTERN = r"^Unnamed"


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop index artefact columns whose name matches ``^Unnamed``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not re.match(UNNAMED_PATTERN, c)])


def has_json_key(raw: Column, key: str) -> Column:
    """True when the JSON object text has ``key`` at top level — also when its value is
    null, which a parsed struct cannot tell apart from a missing key."""
    return F.coalesce(F.array_contains(F.json_object_keys(raw), F.lit(key)), F.lit(False))


def drop_retweets(df: DataFrame, raw_col: str = "raw", include_retweets: bool = False) -> DataFrame:
    """P5: drop posts whose raw JSON carries a ``retweeted_status`` key."""
    if include_retweets:
        return df
    return df.filter(~has_json_key(F.col(raw_col), "retweeted_status"))


def only_text(df: DataFrame, id_col: str = "tweet_id", text_col: str = "text") -> DataFrame:
    """The text projection of the paged source."""
    return df.select(id_col, text_col)


def exclude_replies(df: DataFrame, reply_col: str = "in_reply_to_status_id") -> DataFrame:
    """Timelines without replies."""
    return df.filter(F.col(reply_col).isNull())


def search_predicate(df: DataFrame, keyword: str | None = None, min_faves: int | None = None,
                     since=None, lang: str | None = None, text_col: str = "text",
                     faves_col: str = "favorites", time_col: str = "created_at",
                     lang_col: str = "lang") -> DataFrame:
    """Keyword ∧ ``favorites >= min_faves`` ∧ ``created_at >= since`` ∧ language.
    Each part is optional; the comparisons reach the parquet scan as pushed filters."""
    cond = F.lit(True)
    if keyword is not None:
        cond = cond & F.col(text_col).contains(F.lit(keyword))
    if min_faves is not None:
        cond = cond & (F.col(faves_col) >= F.lit(min_faves))
    if since is not None:
        cond = cond & (F.col(time_col) >= F.lit(since))
    if lang is not None:
        cond = cond & (F.col(lang_col) == F.lit(lang))
    return df.filter(cond)


def is_target(pred: Column, target: str) -> Column:
    """P10: prediction contains the target class (NULL prediction -> False)."""
    return F.coalesce(pred.contains(F.lit(target)), F.lit(False))


def is_measurable(pred: Column) -> Column:
    """Prediction carries a label."""
    return F.coalesce(pred.contains(F.lit(LABEL_PREFIX)), F.lit(False))


def class_split(df: DataFrame, target: str, pred_col: str = "prediction") -> DataFrame:
    """P10 as one pass: a ``split`` column ('target' / 'other') instead of two scans."""
    return df.withColumn("split", F.when(is_target(F.col(pred_col), target), "target").otherwise("other"))


def select_by_name(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns are picked by name, never by position."""
    return df.select(*names)


def stringify(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Text form of every (or the listed) column, for text sinks."""
    cols = df.columns if cols is None else cols
    return df.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c) for c in df.columns])


def post_link(screen_name: Column, tweet_id: Column) -> Column:
    """Link to a post."""
    return F.concat(F.lit("https://twitter.com/"), screen_name, F.lit("/status/"), tweet_id.cast("string"))


def label_line(label: Column, words: Column) -> Column:
    """A training line ``__label__X, w1 w2 ...``."""
    return F.concat(F.lit(LABEL_PREFIX), label, F.lit(", "), words)
