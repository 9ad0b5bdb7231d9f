"""Kept words of plain texts by Arrow batches against the column expressions."""
import random
import unicodedata

import pytest

from postsift.functions import words
from postsift.functions.text import clean_text
from postsift.functions.tokens import DEFAULT_LEXICON, base_forms, tokenize

EVERY = [chr(c) for c in [*range(0x130), *range(0x131, 0x180), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0x20AC]]


def texts():
    r = random.Random(11)
    pieces = [*DEFAULT_LEXICON, "http://a.b/c?x=1", "https://é.fr", "ftp://x", "pic.twitter.com/ab1", "instagram.com/x_y", "@user_1é…", "&amp;", "<b>", "</b", "<", ">", ";", "RT", "3.14", "...", "\n", "\xa0",
              "½", "ﬁ", "Ａ１", "猫が", "カー", "İ", "Σ", "١", "\U0001f600", "é", "Ça", "IST", "Est"]
    out = [c for c in EVERY] + [f"a{c}B{c}{c} {c}" for c in EVERY] + ["".join(EVERY)]
    for _ in range(600):
        some = [r.choice(pieces) if r.random() < 0.5 else "".join(r.choice(EVERY) for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 12))]
        out.append(r.choice(["", " ", "."]).join(some))
    return [*out, "", " ", None, "." * 7, "the and", "The cat is ON the mat."]


@pytest.mark.parametrize("chars", [words.TEXT_CHARS, 40])
def test_words_are_those_of_the_chain(spark, chars, monkeypatch):
    import pyarrow as pa
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    want = [r.w for r in df.select("i", base_forms(tokenize(clean_text("t"))).alias("w")).orderBy("i").collect()]
    got = [r.w for r in df.select("i", words.kept_words("t").alias("w")).orderBy("i").collect()]
    assert [(t, g, w) for t, g, w in zip(rows, got, want) if g != w] == []
    monkeypatch.setattr(words, "TEXT_CHARS", chars)
    plain = words.plain_words.func(pa.array(rows)).to_pylist()
    assert [(t, p, w) for t, p, w in zip(rows, plain, want) if p is not None and p != w] == []
    assert [t for t, p in zip(rows, plain) if p is None and t is not None and set(t) <= set(EVERY)] == []
    assert words.plain_words.func(pa.array([], pa.string())).to_pylist() == []


def test_plain_code_points_agree():
    """Letters and numbers of the JVM's patterns are Python's, and stay below the table's end."""
    for c in EVERY:
        assert c.isalnum() == (unicodedata.category(c)[0] in "LN")
        assert all(ord(x) < words.CODES for x in unicodedata.normalize("NFKC", c.lower()))


def test_other_texts_take_the_chain(spark):
    """The patterns stay in the plan, behind what is done by Arrow batches."""
    plan = spark.createDataFrame([("x",)], "t string").select(words.kept_words("t").alias("w"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("plain_words(") <= 2 and plan.count("ArrowEvalPython") == 2
