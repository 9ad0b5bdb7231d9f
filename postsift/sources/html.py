"""Scraped HTML pages.

An element is matched once, and all its attributes are taken from that match, so lists of
unequal lengths cannot shift against each other: what an element lacks is NULL in its own
row, and its page is reported as not aligned.  A page is one row, so all of this is a
per-row projection: no shuffle.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import count_text_to_long, first_path_segment, scrape_time_to_minute
from ..functions.text import scrape_clean, strip_tags
from ..operators.dedupe import rotate_positions
from .html_tree import nested_elements

# One anchor element; its target and its text.
ANCHOR_ELEMENT = r'(?s)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'
ANCHOR_PARTS = {
    "href": (r'(?s)^<a\s[^>]*?href="([^"]*)"', 1),
    "anchor": (r"(?s)^<a\s[^>]*>(.*?)</a>$", 1),
}
# One post element of a search page, and the seven values of it.
POST_ELEMENT = r'(?s)<li\b[^>]*\bjs-stream-item\b.*?</li>'
POST_PARTS = {
    "user_id": (r'(?s)<a(?=[^>]*\bjs-account-group\b)[^>]*\bdata-user-id="([^"]*)"', 1),
    "permalink": (r'(?s)<a(?=[^>]*\bjs-permalink\b)[^>]*\bhref="([^"]*)"', 1),
    "title": (r'(?s)<a(?=[^>]*\bjs-permalink\b)[^>]*\btitle="([^"]*)"', 1),
    "user_name": (r'(?s)<div(?=[^>]*\bjs-stream-tweet\b)[^>]*\bdata-name="([^"]*)"', 1),
    "tweet_id": (r'(?s)<div(?=[^>]*\bjs-stream-tweet\b)[^>]*\bdata-conversation-id="([^"]*)"', 1),
    "likes": (r'(?s)(<span\b[^>]*\bid="profile-tweet-action-favorite-count-aria-\w+"[^>]*>.*?</span>)', 1),
    "body": (r'(?s)(<p\b[^>]*\bTweetTextSize\b[^>]*>.*?</p>)', 1),
}


def elements(pages: DataFrame, html_col: str, element: str, parts: Mapping[str, tuple], keep=("page_id",)) -> DataFrame:
    """S5 + J5 + W3: one row per element of a page, with its position ``pos``, the rotated
    output order ``seq`` of the reference's ``[i-1]`` indexing (the last element comes
    first), ``n_items`` of the page, the parts (NULL when the element lacks one), and
    ``aligned``: whether all elements of the page have all parts."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(element), 0)
    return _positions(pages, found, parts, keep)


def _positions(pages: DataFrame, found: Column, parts: Mapping[str, tuple], keep) -> DataFrame:
    def part(e, pattern, group):
        return F.when(e.rlike(pattern), F.regexp_extract(e, pattern, group))

    rows = F.transform(found, lambda e: F.struct(*[part(e, p, g).alias(n) for n, (p, g) in parts.items()]))
    z = pages.select(*keep, rows.alias("rows"))
    whole = F.forall("rows", lambda r: _all_there(r, list(parts)))
    z = z.select(*keep, F.size("rows").alias("n_items"), whole.alias("aligned"), F.posexplode_outer("rows").alias("pos", "z"))
    z = z.filter(F.col("pos").isNotNull())   # outer + filter: no inferred filter pushed below shuffles
    return z.select(*keep, F.col("pos").cast("bigint").alias("pos"), rotate_positions(F.col("pos"), F.col("n_items")).cast("bigint").alias("seq"),
                    F.col("n_items").cast("bigint").alias("n_items"), "aligned", *[F.col(f"z.{c}").alias(c) for c in parts])


def _all_there(r, names):
    out = r[names[0]].isNotNull()
    for n in names[1:]:
        out = out & r[n].isNotNull()
    return out


def page_links(pages: DataFrame, html_col: str = "html", keep=("page_id",)) -> DataFrame:
    """S5 + J5 + F40 + F41 on anchors: one row per link with its rotated order."""
    z = elements(pages, html_col, ANCHOR_ELEMENT, ANCHOR_PARTS, keep)
    return z.select(*keep, "pos", "seq", "n_items", "aligned", "href", strip_tags(F.col("anchor")).alias("anchor_text"),
                    first_path_segment(F.col("href")).alias("first_segment"))


def page_posts(pages: DataFrame, html_col: str = "html", keep=("page_id",)) -> DataFrame:
    """The posts of scraped search pages as the seven columns of a `posts_scrape` file
    (user_id, screen_name, user_name, favorites, created_at, text, tweet_id) with their
    order (F36, F38-F41, W3)."""
    return _posts(elements(pages, html_col, POST_ELEMENT, POST_PARTS, keep), keep)


def page_posts_nested(pages: DataFrame, html_col: str = "html", keep=("page_id",)) -> DataFrame:
    """`page_posts` for pages whose posts hold lists, comments, scripts or quoted posts.  A quoted
    post is a row of its own, behind the one it stands in; ``parent`` is that one's ``pos``."""
    z = pages.select(*keep, nested_elements(F.col(html_col), "li", "js-stream-item").alias("items"))
    rows = _positions(z, F.col("items.html"), POST_PARTS, [*keep, "items"])
    parent = F.get("items.parent", F.col("pos").cast("int"))
    return _posts(rows.withColumn("parent", parent), [*keep, "parent"])


def _posts(z: DataFrame, keep) -> DataFrame:
    return z.select(*keep, "pos", "seq", "aligned", F.col("user_id").try_cast("bigint").alias("user_id"),
                    first_path_segment(F.col("permalink")).alias("screen_name"), strip_tags(F.col("user_name")).alias("user_name"),
                    count_text_to_long("likes").alias("favorites"), scrape_time_to_minute("title").alias("created_at"),
                    scrape_clean(F.col("body")).alias("text"), strip_tags(F.col("tweet_id")).try_cast("bigint").alias("tweet_id"))
