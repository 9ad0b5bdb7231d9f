"""Segmentation by a lexicon against all paths, and on Japanese literals."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.functions.tokens import base_forms
from postsift.operators import lattice

JAPANESE = {"東京": 500, "京都": 500, "東": 900, "都": 700, "に": 200, "住む": 600, "住": 900, "む": 900, "猫": 500, "が": 200, "好き": 500, "です": 300, "で": 400, "す": 900}


def all_paths(text, lexicon, unknown):
    """(cost, lengths from the end, words) of every path, by recursion over the last word."""
    if not text:
        return [(0, (), ())]
    out = []
    for k in range(1, len(text) + 1):
        w = text[-k:]
        if w in lexicon or k == 1:
            cost = lexicon.get(w, unknown)
            out += [(c + cost, (-k, *back), (*ws, (w, w in lexicon, cost))) for c, back, ws in all_paths(text[:-k], lexicon, unknown)]
    return out


def brute(text, lexicon, unknown):
    if text is None:
        return None
    words = []
    for w, known, cost in min(all_paths(text, lexicon, unknown))[2]:
        if known or not w.isspace():
            grows = not known and w.isalnum() and words and not words[-1][1] and words[-1][0][-1].isalnum() and not words[-1][3]
            if grows:
                words[-1] = (words[-1][0] + w, False, words[-1][2] + cost, False)
            else:
                words.append((w, known, cost, False))
        elif words:
            words[-1] = (*words[-1][:3], True)       # white space lies behind
    return [w[:3] for w in words]


def test_japanese(spark):
    lexicon = spark.createDataFrame(list(JAPANESE.items()), "surface string, cost long")
    rows = [(1, "東京都に住む"), (2, "猫が好きです"), (3, "ネコが好き!"), (4, None), (5, ""), (6, " 　\n")]
    df = spark.createDataFrame(rows, "id int, text string")
    out = {r.id: r.words for r in lattice.segment_words(df, lexicon, 2000).collect()}
    plain = {k: None if v is None else [w.surface for w in v] for k, v in out.items()}
    assert plain == {1: ["東京", "都", "に", "住む"], 2: ["猫", "が", "好き", "です"], 3: ["ネコ", "が", "好き", "!"], 4: None, 5: [], 6: []}
    assert [(w.surface, w.known, w.cost) for w in out[3]] == [("ネコ", False, 4000), ("が", True, 200), ("好き", True, 500), ("!", False, 2000)]
    # further on as tokens
    pos = {"が": ("conjunction", "*"), "です": ("verb", "だ")}
    words = lattice.segment_words(df, lexicon, 2000).select("id", base_forms(lattice.surfaces("words"), pos).alias("w"))
    assert {r.id: r.w for r in words.collect()}[2] == ["猫", "好き", "だ"]


@pytest.mark.parametrize("part_rows,part_bytes", [(None, None), (3, None), (None, 6)])
def test_same_as_all_paths(spark, part_rows, part_bytes):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("ab猫\U0001f600 -") for _ in range(n))
    lexicon = {}
    while len(lexicon) < 14:
        w = word(r.randint(1, 4)).replace(" ", "")
        if w:
            lexicon[w] = r.randint(1, 6)        # many ties
    texts = [(i, word(r.randint(0, 10)), 1) for i in range(120)] + [(None, "ab猫", 1), (7, None, 2), (7, "abab", 2), (7, "abab", 2)]
    df = spark.createDataFrame(texts, "id int, text string, words int")
    table = spark.createDataFrame([*lexicon.items(), *[(w, c + 3) for w, c in lexicon.items()], (None, 1), ("", 1), ("a", None)], "surface string, cost long")
    got = lattice.segment_words(df, table, 5, part_rows=part_rows, part_bytes=part_bytes)
    assert got.columns == ["id", "text", "words"] and got.count() == len(texts)
    for row in got.collect():
        want = brute(row.text, lexicon, 5)
        assert (None if row.words is None else [tuple(w) for w in row.words]) == want, row.text


def test_long_texts_and_empty_tables(spark):
    lexicon = spark.createDataFrame([("ab", 1), ("a", 1)], "surface string, cost long")
    df = spark.createDataFrame([(1, "ab" * 100_000 + "c" * 50_000)], "id int, text string")
    words = lattice.segment_words(df, lexicon, 9)
    assert tuple(words.select(F.size("words"), F.length(F.element_at("words", -1)["surface"])).first()) == (100_001, 50_000)
    assert lattice.segment_words(df.limit(0), lexicon, 9).collect() == []
    assert [len(w.surface) for w in lattice.segment_words(df, lexicon.limit(0), 9).first().words] == [250_000]


def test_costs_of_counts(spark):
    tokens = spark.createDataFrame([("a",)] * 10 + [("b",)] * 20 + [("c",)] * 3 + [("",), (None,)], "token string")
    lexicon, unknown = lattice.learn_costs(tokens, floor=10)
    assert {r.surface: r.cost for r in lexicon.collect()} == {"a": int(1000 * np.log(31 / 10)), "b": int(1000 * np.log(31 / 20))}
    assert unknown == int(1000 * np.log(62)) and lattice.learn_costs(tokens.limit(0))[0].count() == 0


def test_no_text_is_shuffled(spark):
    lexicon = spark.createDataFrame([("ab", 1)], "surface string, cost long")
    df = spark.createDataFrame([(1, "ab")], "id int, text string")
    plan = lattice.segment_words(df, lexicon, 9)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_a_task_holds_few_texts_at_a_time(spark, monkeypatch):
    """A batch of many texts leaves the task in slices, by several parts of the lexicon too."""
    import pyarrow as pa
    monkeypatch.setattr(lattice, "TEXT_CHARS", 1000)
    monkeypatch.setattr(lattice, "OUT_WORDS", 200)
    made = []
    monkeypatch.setattr(lattice, "automaton", lambda words, f=lattice.automaton: made.append(words) or f(words))
    parts = [(pa.array(["ab"]), pa.array([1])), (pa.array(["c"]), pa.array([2])), (pa.array([], pa.string()), pa.array([], pa.int64()))]
    texts = ["abc" * 20, None, ""] * 100
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], ["id", "text"])
    out = list(lattice._segmenter(parts, 9, ["id", "words"], 1)(iter([batch])))
    assert max(pa.compute.list_flatten(b.column(1)).__len__() for b in out) <= 240 and len(out) > 15
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(300))
    words = [w for b in out for w in b.column(1).to_pylist()]
    want = [{"surface": "ab", "known": True, "cost": 1}, {"surface": "c", "known": True, "cost": 2}] * 20
    assert words == [want, None, []] * 100 and 2 < len(made) < 20


@pytest.mark.parametrize("step_runs,step_chars", [(32, 64), (1, 1), (3, 2), (10**6, 0)])
def test_runs_that_step_together_are_as_alone(monkeypatch, step_runs, step_chars):
    """Paths of many runs at once, of a few long ones one by one, and of costs beyond 64 bits."""
    import pyarrow as pa
    monkeypatch.setattr(lattice, "STEP_RUNS", step_runs)
    monkeypatch.setattr(lattice, "STEP_CHARS", step_chars)
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abc猫1- ") for _ in range(n))
    lexicon = {w: c for w, c in {w.replace(" ", ""): r.randint(0, 5) for w in (word(r.randint(1, 4)) for _ in range(25))}.items() if w}
    texts = [word(r.randint(0, 9)) for _ in range(150)]
    for scale in (1, 10**16):
        parts = [(pa.array(list(lexicon)), pa.array([c * scale for c in lexicon.values()], pa.int64()))]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
        out = [w for b in lattice._segmenter(parts, 4 * scale, ["id", "words"], 1)(iter([batch])) for w in b.column(1).to_pylist()]
        for text, got in zip(texts, out):
            assert [(w["surface"], w["known"], w["cost"] // scale) for w in got] == brute(text, lexicon, 4), text


def test_equal_runs_are_cut_once(monkeypatch):
    """Texts of the same words: one path a distinct run, and no path in Python for the short ones."""
    import pyarrow as pa
    seen = []
    monkeypatch.setattr(lattice, "_paths", lambda lengths, *a, f=lattice._paths: seen.append(len(lengths)) or f(lengths, *a))
    monkeypatch.setattr(lattice, "least_path", lambda *a: 1 / 0)
    parts = [(pa.array(["the", "cat", "sat"]), pa.array([1, 2, 3]))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(["thecat sat, thecat 12x"] * 500)], ["id", "text"])
    out = [w for b in lattice._segmenter(parts, 9, ["id", "words"], 1)(iter([batch])) for w in b.column(1).to_pylist()]
    assert seen == [2] and len(out) == 500
    assert {tuple((x["surface"], x["known"], x["cost"]) for x in w) for w in out} == {(("the", True, 1), ("cat", True, 2), ("sat", True, 3), (",", False, 9), ("the", True, 1), ("cat", True, 2), ("12x", False, 27))}


def test_ascii_letters_only(spark):
    from postsift.functions.text import ascii_lower
    df = spark.createDataFrame([(1, "AZaz Äİ\u212a[`{"), (2, None), (3, "")], "i int, t string")
    assert {r.i: r.c for r in df.select("i", ascii_lower("t").alias("c")).collect()} == {1: "azaz Äİ\u212a[`{", 2: None, 3: ""}
