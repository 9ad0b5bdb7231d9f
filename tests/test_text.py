"""Cleaning chain: literal edge cases (FIXTURES.md §3) and Spark ≡ Python `re` semantics."""
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from postsift.functions.text import clean_text, py_clean, scrape_clean, py_steps, SCRAPE_STEPS, tidy_text

CASES = [
    ("a.bcd..e.", "ad。"),
    ("PRTIMES RT", "pimes"),
    ("a１２3b", "a0b"),
    ("x@太郎_1 hi", "x hi"),
    ("A&B C&amp;D", "a cd"),
    ("　a　", "a"),
    ("＃ａ…", "#a..."),
    ("<b>bold</b> pic.twitter.com/abc x", "bold  x"),
    ("see https://example.com/x?y=1 now", "see  now"),
    ("line1\nline2", "line0line0"),
]


@pytest.mark.parametrize("src,expected", CASES)
def test_python_twin_matches_fixture(src, expected):
    assert py_clean(src) == expected


def test_spark_chain_matches_fixtures(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_text("t").alias("c")).collect()}
    assert [got[i] for i in range(len(CASES))] == [e for _, e in CASES]


ALPHABET = st.sampled_from(list("aAzZ09 .,;#@&!?()[]/<>\n\r\t") + list("ＲＴ１２、・，．「」【】（）？！…太郎ー猫éß　  ٣"))


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), min_size=200, max_size=200))
def test_spark_equals_python_on_random_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", clean_text("t").alias("c"), scrape_clean("t").alias("s")).collect()
    for r in rows:
        assert r.c == py_clean(texts[r.i]), texts[r.i]
        assert r.s == py_steps(texts[r.i], SCRAPE_STEPS), texts[r.i]


def test_tidy_keeps_null(spark):
    df = spark.createDataFrame([(1, " a\r\nb 　"), (2, None)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", tidy_text("t").alias("c")).collect()}
    assert got == {1: "a\nb", 2: None}


def test_nfkc_of_arrow_batches(monkeypatch):
    import unicodedata

    import pyarrow as pa

    from postsift.functions import text
    monkeypatch.setattr(text, "NFKC_ROWS", 3)
    plain = pa.array(["abc", None, "", "é", "ü ß", "x"])
    assert text._nfkc(plain) is plain              # no copy of normal texts
    rows = ["abc", None, "ﬁ", "e\u0301", "", "Ａ１", "가", "ok", None, "½"]
    assert text._nfkc(pa.array(rows)).to_pylist() == [None if t is None else unicodedata.normalize("NFKC", t) for t in rows]
    assert text._nfkc(pa.array([], pa.string())).to_pylist() == []
