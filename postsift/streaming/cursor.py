"""Paged searches as resumable stream state (S16 with W2 / L1).

A search is fetched page by page: each request asks for posts up to a cursor (``max_id``), the
next cursor is one below the last post, retweets are left out, and the search ends at an empty
page or when ``total`` posts are taken.  Landed pages have the columns

* ``search``  key of the search,
* ``seq``     number of the request within the search, from 0,
* ``page``    the response text (``{"statuses": [...]}``).

``cursor_stream`` keeps one small state per search (next request, cursor, posts taken, whether
it ended), not one key per post.  A page that lands before its predecessors waits in the state;
so the result does not depend on how landings fall into triggers, and a stopped stream goes on
where its checkpoint is.  ``cursor_batch`` gives the same rows for a table of pages.

Defined results:

* A post above the cursor (pages overlap when posts arrive meanwhile) is left out.
* A null page or one without a readable list of posts ends its search, as an empty page does.
* After a missing request nothing of the search is taken; the stream takes it when it lands.
* Equal (search, seq) landings are one page; pages after the end of a search are ignored.
* A post without an id is taken and does not move the cursor.
* ``total`` <= 0 means no limit.  A null search or seq is no request: such rows are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from ..operators.filters import has_json_key
from ..sources.json_posts import SHAPES

POST = "struct<id:bigint,is_retweet:boolean,raw:string>"
PAGE = "ids array<bigint>, retweets array<boolean>, raws array<string>"     # as the state holds it
OUT = "seq bigint, pos bigint, nth bigint, raw string"
HELD_CHARS = 1 << 20        # of early pages of one search that a task holds before they go to the state


def _posts(page: Column) -> Column:
    """The posts of a page; an empty array when it has none or cannot be read."""
    def post(raw):
        text_id = F.get_json_object(raw, "$.id_str").try_cast("bigint")
        return F.struct(F.coalesce(F.get_json_object(raw, "$.id").try_cast("bigint"), text_id).alias("id"),
                        has_json_key(raw, "retweeted_status").alias("is_retweet"), raw.alias("raw"))

    raws = F.filter(F.from_json(page, SHAPES["search"])["statuses"], lambda raw: raw.isNotNull())
    return F.coalesce(F.transform(raws, post), F.array().cast(f"array<{POST}>"))


def _requests(pages: DataFrame, search: str, seq: str, page: str) -> DataFrame:
    rows = pages.select(F.col(search).alias("search"), F.col(seq).cast("bigint").alias("seq"), _posts(F.col(page)).alias("posts"))
    return rows.filter(F.col("search").isNotNull() & (F.col("seq") >= 0))


class SearchCursor(StatefulProcessor):
    """Takes the pages of one search in the order of their requests.

    A call of the state is a message to the JVM.  Early pages are held while the rows of a
    trigger pass, and the map is asked only where it can have something: what lands out of order
    within a trigger, and a search that has ended, cost no messages."""

    def __init__(self, total: int = 0, ttl_ms: int | None = None):
        self.total = total
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next bigint, max_id bigint, taken bigint, ended boolean", self.ttl_ms)
        self.early = handle.getMapState("early", "seq bigint", PAGE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        start = self.at.get()
        nxt, max_id, taken, ended = start if start else (0, None, 0, False)
        if ended:
            if self.ttl_ms is not None:         # the search had a page: it is not forgotten yet
                self.at.update(tuple(start))
            return
        held, chars, stored = {}, 0, start is not None     # stored: the map may have pages of this search
        for row in rows:
            if ended:
                break
            page = row.ids, row.retweets, row.raws
            if row.seq > nxt:
                chars += sum(map(len, row.raws)) - sum(map(len, held[row.seq][2] if row.seq in held else ()))
                held[row.seq] = page
                if chars > HELD_CHARS:
                    self._store(held)
                    held, chars, stored = {}, 0, True
            if row.seq != nxt:
                continue
            while page is not None:
                least = max_id
                for pos, (pid, is_retweet, raw) in enumerate(zip(*page)):
                    if pid is not None and (least is None or pid <= least):
                        least = pid - 1
                    above = pid is not None and max_id is not None and pid > max_id
                    if not (is_retweet or above or ended):
                        taken += 1
                        ended = taken == self.total
                        yield Row(search=key[0], seq=nxt, pos=pos, nth=taken, raw=raw)
                max_id, nxt, ended = least, nxt + 1, ended or len(page[0]) == 0
                page = None
                if not ended:
                    page = held.pop(nxt, None)
                    if page is not None:
                        chars -= sum(map(len, page[2]))
                    if stored and (page is not None or self.early.containsKey((nxt,))):
                        page = page if page is not None else self.early.getValue((nxt,))
                        self.early.removeKey((nxt,))
        if not ended:
            self._store(held)
        elif stored:
            self.early.clear()
        if start is None or self.ttl_ms is not None or (nxt, max_id, taken, ended) != tuple(start):
            self.at.update((nxt, max_id, taken, ended))

    def _store(self, held: dict) -> None:
        for seq, page in held.items():
            self.early.updateValue((seq,), page)

    def close(self) -> None:
        pass


def cursor_stream(pages: DataFrame, total: int = 0, ttl_ms: int | None = None,
                  search: str = "search", seq: str = "seq", page: str = "page") -> DataFrame:
    """The posts that the searches take: search, seq, pos (place in its page), nth (from 1 in its
    search) and raw (the post's JSON).  Needs the RocksDB state store.  With ``ttl_ms`` a search
    that has had no page for so long is forgotten (and would start anew)."""
    rows = _requests(pages, search, seq, page)
    kind = rows.schema["search"].dataType.simpleString()
    rows = rows.select("search", "seq", F.col("posts.id").alias("ids"), F.col("posts.is_retweet").alias("retweets"), F.col("posts.raw").alias("raws"))
    return rows.groupBy("search").transformWithState(
        statefulProcessor=SearchCursor(total, ttl_ms), outputStructType=f"search {kind}, {OUT}",
        outputMode="append", timeMode="None" if ttl_ms is None else "ProcessingTime")


def cursor_batch(pages: DataFrame, total: int = 0, search: str = "search", seq: str = "seq", page: str = "page") -> DataFrame:
    """``cursor_stream`` over a table.  Only (search, seq, a number) pass through the windows; the
    posts meet them by a join on the request."""
    rows = _requests(pages, search, seq, page).groupBy("search", "seq").agg(F.any_value("posts").alias("posts"))
    in_order = Window.partitionBy("search").orderBy("seq")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.select("search", "seq", (F.array_min(F.transform("posts", lambda p: p["id"])) - 1).alias("below"), (F.size("posts") == 0).alias("none"))
    heads = heads.select("search", "seq", F.min("below").over(earlier).alias("max_id"), "none",
                         F.coalesce(F.max("none").over(earlier), F.lit(False)).alias("ended"), (F.row_number().over(in_order) - 1).alias("at"))
    heads = heads.filter(~F.col("none") & ~F.col("ended") & (F.col("at") == F.col("seq"))).select("search", "seq", "max_id")
    placed = F.transform("posts", lambda p, i: F.struct(i.cast("bigint").alias("pos"), p.alias("p")))
    mine = rows.withColumn("placed", placed).join(heads, ["search", "seq"])
    kept = F.filter("placed", lambda x: ~x["p"]["is_retweet"] & F.coalesce(x["p"]["id"] <= F.col("max_id"), F.lit(True)))
    mine = mine.select("search", "seq", kept.alias("kept"))
    counts = mine.select("search", "seq", F.size("kept").alias("n"))
    before = counts.select("search", "seq", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    if total > 0:
        before = before.filter(F.col("before") < total)
    out = mine.join(before, ["search", "seq"]).select("search", "seq", "before", F.posexplode_outer("kept").alias("i", "x"))
    out = out.filter(F.col("i").isNotNull()).select("search", "seq", F.col("x.pos").alias("pos"), (F.col("before") + F.col("i") + 1).alias("nth"), F.col("x.p.raw").alias("raw"))
    return out.filter(F.col("nth") <= total) if total > 0 else out
