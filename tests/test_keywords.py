"""Keyword tables against plain containment."""
import random

import pytest

from postsift.operators import keywords as kw


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute(posts, table):
    pairs = {(c, k) for c, k in table if k}
    return sorted(((i, c, k, None if c is None else "__label__" + c) for i, t in posts for c, k in pairs if t and k in t), key=str)


@pytest.mark.parametrize("part_rows,part_bytes", [(None, None), (7, None), (None, 40)])
def test_same_as_containment(spark, part_rows, part_bytes):
    r = random.Random(3)
    letters = "ab猫é\U0001f600 "
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    posts = [(i, word(r.randint(0, 60))) for i in range(80)] + [(500, None), (501, ""), (None, "ab猫"), (5, "aaaa"), (5, "aaaa"), (6, "x" * 200_000 + "猫耳")]
    table = [(r.choice("XYZ"), word(r.randint(1, 4))) for _ in range(60)] + [("X", "a"), ("Y", "aa"), ("Y", "a"), ("X", "a"), (None, "aaa"), ("X", None), ("X", ""), ("Z", "猫耳")]
    df = spark.createDataFrame([(*p, 9) for p in posts], "id long, text string, keyword int")
    t = spark.createDataFrame(table, "category string, keyword string")
    assert rows(kw.keyword_match(df, t, ["id"], part_rows=part_rows, part_bytes=part_bytes)) == brute(posts, table)


def test_parts_and_empty_tables(spark):
    t = spark.createDataFrame([("c", f"word{i}") for i in range(100)], "category string, keyword string")
    _, parts = kw.keyword_parts(t, part_rows=10)
    assert parts == 13 and kw.keyword_parts(t)[1] == 1
    df = spark.createDataFrame([(1, "a word7 word77")], "id long, text string")
    assert [r.keyword for r in kw.keyword_match(df, t, ["id", "text"]).orderBy("keyword").collect()] == ["word7", "word77"]
    assert kw.keyword_match(df, t.limit(0), ["id"]).collect() == [] and kw.keyword_match(df.limit(0), t, ["id"]).collect() == []


def test_no_text_is_shuffled(spark):
    t = spark.createDataFrame([("c", "word")], "category string, keyword string")
    df = spark.createDataFrame([(1, "a word")], "id long, text string")
    p = kw.keyword_match(df, t, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in p and "MapInArrow" in p
