"""The Jaccard join against a comparison of all pairs."""
import random

import numpy as np
import pytest

from postsift.llm import jaccard_join as jj
from postsift.llm.components import connected
from postsift.llm.hashing import shingle_set, word_hashes
from postsift.llm.scratch import Scratch

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    out, cur = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c.lower() if "A" <= c <= "Z" else c
    return out


def shingles(text, width=3):
    w = words(text)
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, num=90, den=100, width=3):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [(d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def order(rows):
    return sorted(rows, key=str)


def got(df, **kw):
    return order([(r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_components(df, **kw).collect()])


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def near_copies(n, length, edits, seed, vocabulary=4000):
    """Groups of texts with 0 to ``edits`` changed words, a shared passage and noise."""
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, vocabulary)}"
    passage = [word() for _ in range(60)]
    out = []
    for g in range(n):
        base = [word() for _ in range(r.randint(8, length))]
        if g % 3 == 0:
            base[4:4] = passage
        for _ in range(r.choice([1, 1, 2, 6, 25])):
            own = list(base)
            for _ in range(r.randint(0, edits)):
                i = r.randrange(len(own))
                own[i:i + 1] = r.choice([[word()], [], [own[i], word()]])
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("num", [90, 95])
def test_same_as_all_pairs(spark, num):
    rows = list(enumerate(near_copies(30, 150, 6, num)))
    assert got(frame(spark, rows), num=num) == order(brute(rows, num))


@pytest.mark.parametrize("num", [80])
def test_five_words(spark, num):
    rows = list(enumerate(near_copies(30, 150, 6, num + 1)))
    assert got(frame(spark, rows), num=num, width=5) == order(brute(rows, num, width=5))


@pytest.mark.parametrize("rounds", [2])
def test_near_copies_on_both_sides_of_the_threshold(spark, monkeypatch, rounds):
    """One large group of variants that partly link, with a passage that all have."""
    monkeypatch.setattr(jj, "ROUNDS", rounds)
    monkeypatch.setattr(jj, "GROUP_TOKENS", 1500)
    monkeypatch.setattr(jj, "QUERY_TOKENS", 1500)
    r = random.Random(rounds)
    base, passage = [f"w{i}" for i in range(60)], [f"p{i}" for i in range(20)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(r.randint(0, 7)):
            own[r.randrange(60)] = f"x{r.randint(0, 40)}"
        rows.append((i, " ".join(own + passage if i % 3 else own)))
    rows += [(1000 + i, " ".join([f"u{i}_{j}" for j in range(30)] + passage)) for i in range(40)]
    for num, width in ((80, 5), (90, 3)):
        assert got(frame(spark, rows), num=num, width=width) == order(brute(rows, num, width=width))


def test_small_groups_and_parts(spark, monkeypatch):
    """Groups and queries are split and the results stay whole."""
    monkeypatch.setattr(jj, "GROUP_TOKENS", 400)
    monkeypatch.setattr(jj, "QUERY_TOKENS", 300)
    rows = list(enumerate(near_copies(12, 90, 5, 77)))
    assert got(frame(spark, rows)) == order(brute(rows))


def test_chain_is_one_component(spark):
    """Neighbours link, the ends do not."""
    base = [f"a{i}" for i in range(200)]
    rows = [(100 - k, " ".join(base[k * 3:k * 3 + 120])) for k in range(20)]
    assert got(frame(spark, rows)) == order(brute(rows))
    assert {c for *_, c in brute(rows)} == {81}


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "oNE"), (6, "one two"), (7, "ONE\ttwo "), (8, "a b c"), (8, "a b c"),
            (None, "A B\nC"), (None, "lonely null"), (None, None), (9, long), (10, long + " end"), (11, "é É é"), (12, "É É é"),
            (13, "a b c a b c a b c"), (14, "a\x85b c d"), (15, "a b\x1cc d"), (2, "")]
    assert got(frame(spark, rows)) == order(brute(rows))


def test_empty_and_clashing_columns(spark):
    assert got(frame(spark, [])) == []
    df = spark.createDataFrame([(1, "a b c d", 5, "s"), (2, "a b c d", 6, "t")], "doc_id long, text string, cid int, id string")
    assert got(df) == [(1, 2, 1), (2, 2, 1)]
    assert sorted(r.cid for r in jj.keep_one(df).collect()) == [5]


def test_keep_one(spark):
    rows = list(enumerate(near_copies(15, 90, 4, 5))) + [(500, None), (501, ""), (502, " "), (None, "q w e r t y"), (None, "q w e r t y"), (503, "q w e r t y")]
    want = order([(d, t) for (d, t), (_, n, c) in zip(rows, brute(rows)) if n == 0 or d == c and d is not None])
    assert order([tuple(r) for r in jj.keep_one(frame(spark, rows)).collect()]) == want
    twice = [(1, "a b c d"), (1, "a b c d"), (1, "x y z"), (None, "only null here"), (None, "only null here")]
    kept = order([tuple(r) for r in jj.keep_one(frame(spark, twice)).collect()])
    assert kept == order([(1, "a b c d"), (1, "x y z"), (None, "only null here")])


def test_word_hashes_are_of_words():
    texts = ["", "a", " a b\tc\nd\x0be\x0cf\rg ", "Ab aB AB", "é日 é日", "a b", "x" * 1000 + " y"]
    seen = {}
    for t in texts:
        w = words(t)
        h = word_hashes(t).tolist()
        assert len(h) == len(w)
        for a, b in zip(w, h):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_pieces_of_long_texts(monkeypatch):
    from postsift.llm import hashing
    text = " ".join(f"word{i} {'z' * (i % 50)}" for i in range(2000))
    whole = word_hashes(text)
    monkeypatch.setattr(hashing, "PIECE_BYTES", 100)
    assert np.array_equal(word_hashes(text), whole)
    assert np.array_equal(word_hashes("q" * 100_000), hashing.word_hashes("q" * 100_000))


@pytest.mark.parametrize("num", [50, 80, 90, 95])
def test_prefixes_meet_for_every_linked_pair(num):
    """Linked sets share what the prefixes promise, whatever the order of the rare tokens."""
    r = np.random.default_rng(num)
    linked = 0
    for _ in range(3000):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        drop, more = r.integers(0, max(1, n * (100 - num) // 100) + 1, 2)
        b = np.unique(np.concatenate([a[drop:] if r.random() < .5 else r.permutation(a)[drop:], r.integers(0, 2**63, more).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= num * (len(a) + len(b) - both):
            linked += 1
            x, y = jj.prefix(a, num, 100), jj.prefix(b, num, 100)
            least = [jj.shared_at_least(len(s), num, 100) for s in (a, b)]
            assert len(np.intersect1d(x, y)) >= max(least)
            rank = {int(t): (int(r.integers(1, 4)), int(t)) for t in np.union1d(x, y)}
            kept = [set(sorted(map(int, s), key=rank.get)[:len(s) - k + 1]) for s, k in zip((x, y), least)]
            assert kept[0] & kept[1]
    assert linked > 500


def test_shingle_sets_are_of_texts():
    texts = ["a b c", "a b", "a", "a b c d", "b c d a", "a b c a b c", "", None, "A b C"]
    for x in texts:
        for y in texts:
            assert (shingles(x) == shingles(y)) == np.array_equal(shingle_set(x), shingle_set(y))


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1064)] + [(5, 5), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    want = {(n, root(n)) for n in list(up)}
    df = spark.createDataFrame(edges, "a long, b long")
    out = [tuple(r) for r in connected(df, Scratch(spark, "t")).collect()]
    assert set(out) == want and len(out) == len(want)
    assert connected(df.limit(0), Scratch(spark, "t")).count() == 0


def test_sets_are_made_of_classes_that_may_link(spark, monkeypatch):
    """Every text shares most of its shingles with some other, but only the copies share many with one."""
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abcdefghijklmn") for _ in range(100))) for i in range(200)]
    rows += [(1000 + i, t + " z") for i, t in rows[:5]]
    made, plain = [], jj.token_sets
    monkeypatch.setattr(jj, "token_sets", lambda docs, width: made.append(docs.count()) or plain(docs, width))
    assert got(frame(spark, rows)) == order(brute(rows))
    assert 10 <= sum(made) <= 30, made


def test_met_pairs_share_enough():
    import pandas as pd
    lists = [[1, 2, 3, 4], [1, 2, 3, 9], [5, 6, 7, 8], [1, 2, 7, 8]]
    part = lambda at, x: pd.DataFrame({f"{x}n": [40, 40, 40, 40], f"{x}least": [2, 3, 2, 2], f"{x}star": [0, 1, 2, 0], f"{x}tokens": lists, "x" if x else "cid": [0, 1, 2, 3]}).iloc[at]
    found = jj.meet_group(90, 100)((7, -1, 3), part([0, 1, 2, 3], ""), part([1, 2, 3], "x"))
    # 1 with 0 (3 tokens, 3 needed) but not with 3; 2 with 3; not within one star
    assert [tuple(x) for x in found.itertuples(index=False)] == [(7, -1, 3, c, a) for c, a in ((0, False), (2, False), (3, False), (1, True), (2, True), (3, True))]
    assert len(jj.meet_group(90, 100)((7, -1, 3), part([0], ""), part([], "x"))) == 0
