"""Fill-in-middle transformation against plain slicing of code points."""
import hashlib
import random

import pytest

from postsift.llm import infill
from postsift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "a"), (4, "ab<P>cd"), (5, "<S>"), (6, "x <M"), (7, "é日本\U0001f600́ \r\n\x00z"), (7, "é日本\U0001f600́ \r\n\x00z"),
       (None, "no id at all"), (8, "<P" * 50), (9, ">" * 50), (10, "line\n" * 3), (11, "S><P"), (12, "y" * 300_000)]


def plain(doc_id, text):
    """The contract, by slices."""
    text = text or ""
    n = len(text)
    h = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        form, out, cut = "plain", text, (None, None)
    elif h4 % 100 < 20:
        form, out, cut = "spm", "<S>" + text[hi:] + "<P>" + text[:lo] + "<M>" + text[lo:hi], (lo, hi - lo)
    else:
        form, out, cut = "psm", "<P>" + text[:lo] + "<S>" + text[hi:] + "<M>" + text[lo:hi], (lo, hi - lo)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, n, form, *cut, sha(out), sha(text))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_is_the_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_fill_in_middle"](spark, SF)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert rows(got) == sorted((plain(*d) for d in docs), key=str)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 5, "f") for i, t in ODD], "doc_id long, text string, n int, form string")
    assert rows(infill.digests(df)) == sorted((plain(*d) for d in ODD), key=str)
    assert infill.infill(df.limit(0)).collect() == []


def test_every_form_is_restored():
    r = random.Random(4)
    seen = set()
    for i in range(4000):
        text = "".join(r.choice("<>PSMab\n é") for _ in range(r.randint(0, 14)))
        p = infill.transform(text, i, infill.Infill())
        assert infill.restore(p.output, p.form) == text
        seen.add((p.form, p.prefix == 0, p.middle == 0))
    assert len(seen) > 6


def test_general_interface(spark):
    """Other units, seeds and shares; outputs as text."""
    text = "one two  three four\nfive éé"
    for unit, units in ((infill.WORD, ["one ", "two  ", "three ", "four\n", "five ", "éé"]),
                        (infill.GRAPHEME, [*text[:-4], "é", "é"])):
        how = infill.Infill(unit=unit, seed="s", cut_share=100, spm_share=50)
        df = spark.createDataFrame([(str(i), text) for i in range(60)], "key string, body string")
        forms = set()
        for r in infill.infill(df, how, "key", "body").collect():
            assert r.n == len(units) and infill.restore(r.output, r.form) == text
            assert ("<M>" + "".join(units[r.prefix:r.prefix + r.middle])) in r.output
            forms.add(r.form)
        assert forms == {"psm", "spm"}
    with pytest.raises(ValueError):
        infill.transform("a b", 1, infill.Infill(unit="[a-z]"))
