"""Paged searches with a cursor: the stream (several triggers, restarts, pages out of order) and
the table form against a plain loop over requests."""
import json
import random
import tempfile

import pytest

from postsift.streaming import cursor, ingest

SCHEMA = "search string, seq long, page string"


def loop(pages, total):
    """What a client gets that asks request after request."""
    by = {}
    for search, seq, page in pages:
        if search is not None and seq is not None and seq >= 0:
            by.setdefault(search, {})[seq] = page
    out = []
    for search, asked in by.items():
        seq, max_id, taken = 0, None, 0
        while seq in asked:
            try:
                posts = [p for p in json.loads(asked[seq] or "{}").get("statuses") or [] if p is not None]
            except ValueError:
                posts = []
            if not posts:
                break
            for pos, p in enumerate(posts):
                above = max_id is not None and p["id"] is not None and p["id"] > max_id
                if "retweeted_status" in p or above or (total > 0 and taken >= total):
                    continue
                taken += 1
                out.append((search, seq, pos, taken, p["id"]))
            ids = [p["id"] for p in posts if p["id"] is not None]
            max_id = min([i - 1 for i in ids] + ([] if max_id is None else [max_id]), default=None)
            seq += 1
    return sorted(out)


def made(seed):
    rnd = random.Random(seed)
    pages = []
    for search in ("a", "b", "c", "d", "", "hot"):
        i = 2000
        for seq in range(40 if search == "hot" else rnd.randint(1, 9)):
            posts = []
            for _ in range(rnd.randint(1, 5)):
                p = {"id": i if rnd.random() < 0.95 else None, "text": "t"}
                if rnd.random() < 0.3:
                    p["retweeted_status"] = rnd.choice([None, {"id": 1}])
                posts.append(p)
                i -= rnd.choice([1, 1, 3])
            pages.append((search, seq, json.dumps({"statuses": posts})))
            i += rnd.choice([0, 0, 2])                     # the next page repeats posts
    pages += [("gap", 0, json.dumps({"statuses": [{"id": 5}]})), ("gap", 2, json.dumps({"statuses": [{"id": 3}]})),
              ("late", 1, json.dumps({"statuses": [{"id": 3}]})), ("none", 0, '{"statuses":[]}'), ("none", 1, json.dumps({"statuses": [{"id": 3}]})),
              ("null", 0, None), ("null", 1, json.dumps({"statuses": [{"id": 3}]})), ("bad", 0, "<html>"), ("other", 0, '{"errors":[1]}'),
              (None, 0, json.dumps({"statuses": [{"id": 3}]})), ("a", None, json.dumps({"statuses": [{"id": 3}]}))]
    pages += rnd.sample(pages, 8)                          # landed twice
    rnd.shuffle(pages)
    return pages


def plain(df):
    return sorted((r.search, r.seq, r.pos, r.nth, json.loads(r.raw)["id"]) for r in df.collect())


@pytest.mark.parametrize("seed,total", [(1, 0), (2, 7), (3, 1)])
def test_batch_is_the_loop(spark, seed, total):
    pages = made(seed)
    got = plain(cursor.cursor_batch(spark.createDataFrame(pages, SCHEMA), total))
    assert got == loop(pages, total) and len(got) > 5


@pytest.mark.parametrize("seed,total", [(4, 0), (5, 7)])
def test_stream_in_parts_with_restarts_is_the_loop(spark, seed, total):
    pages = made(seed)
    d = tempfile.mkdtemp(prefix="cursor-", dir="/tmp")
    third = len(pages) // 3
    for part in (pages[:third], pages[third:2 * third], pages[2 * third:]):
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(d + "/land")
        got = ingest.follow_searches(spark, d + "/land", SCHEMA, d + "/out", d + "/ck", total, files_per_trigger=1)
    assert plain(got) == loop(pages, total)
    again = ingest.follow_searches(spark, d + "/land", SCHEMA, d + "/out", d + "/ck", total)     # nothing new
    assert plain(again) == loop(pages, total)


def test_empty_and_forgotten(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cursor.cursor_batch(empty, 3).collect() == []
    d = tempfile.mkdtemp(prefix="cursor-", dir="/tmp")
    empty.write.parquet(d + "/land")
    assert ingest.follow_searches(spark, d + "/land", SCHEMA, d + "/out", d + "/ck", 3, ttl_ms=3_600_000).collect() == []
    page = json.dumps({"statuses": [{"id": 3}, {"id": 2}]})
    spark.createDataFrame([("a", 0, page)], SCHEMA).write.mode("append").parquet(d + "/land")
    assert plain(ingest.follow_searches(spark, d + "/land", SCHEMA, d + "/out", d + "/ck", 3, ttl_ms=3_600_000)) == [("a", 0, 0, 1, 3), ("a", 0, 1, 2, 2)]


class Value:
    def __init__(self):
        self.held, self.calls = {}, 0

    def _call(self, run):
        self.calls += 1
        return run()

    def get(self):
        return self._call(lambda: self.held.get("at"))

    def update(self, value):
        self._call(lambda: self.held.update(at=value))

    def containsKey(self, key):
        return self._call(lambda: key in self.held)

    def getValue(self, key):
        return self._call(lambda: self.held.get(key))

    def updateValue(self, key, value):
        self._call(lambda: self.held.update({key: value}))

    def removeKey(self, key):
        self._call(lambda: self.held.pop(key, None))

    def clear(self):
        self._call(self.held.clear)


class Handle:
    def getValueState(self, *_):
        self.at = Value()
        return self.at

    def getMapState(self, *_):
        self.early = Value()
        return self.early


def one_search(total, triggers):
    """nth of the posts that a search takes from triggers of (seq, ids), and its states."""
    from pyspark.sql.types import Row
    handle, taker = Handle(), cursor.SearchCursor(total)
    taker.init(handle)
    out = []
    for rows in triggers:
        rows = [Row(seq=s, ids=ids, retweets=[False] * len(ids), raws=[str(i) for i in ids]) for s, ids in rows]
        out += [(r.seq, r.pos, r.nth, r.raw) for r in taker.handleInputRows(("k",), iter(rows), None)]
    return out, handle


def test_order_within_a_trigger_needs_no_messages():
    pages = [(s, [100 - 2 * s, 99 - 2 * s]) for s in range(6)]
    out, h = one_search(9, [pages[::-1], pages, pages])
    assert [r[2] for r in out] == list(range(1, 10)) and [r[0] for r in out] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
    assert h.early.calls == 0 and h.at.calls == 4          # read in each trigger, written once


@pytest.mark.parametrize("held", [0, 5, 1 << 20])
def test_pages_of_later_triggers_and_held_ones_that_overflow(monkeypatch, held):
    monkeypatch.setattr(cursor, "HELD_CHARS", held)
    pages = [(s, [100 - 2 * s, 99 - 2 * s]) for s in range(9)]
    rnd = random.Random(held)
    for total in (0, 7):
        for _ in range(20):
            landed = pages + rnd.sample(pages, 3)
            rnd.shuffle(landed)
            out, h = one_search(total, [landed[:4], landed[4:5], landed[5:]])
            assert [int(r[3]) for r in out] == list(range(100, 82, -1))[:total or 18]
            assert not h.early.held
