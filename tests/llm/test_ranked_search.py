"""Ranked lexical search against scores of all documents."""
import math
import random
import re

import numpy as np
import pytest

from postsift.llm import ranked_search as rs
from postsift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    bags = [words(t) for _, t in docs]
    n_docs, n_terms = sum(map(bool, bags)), sum(map(len, bags))
    df = {}
    for b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in queries.items():
        scored = []
        for (d, _), b in zip(docs, bags):
            s = 0
            for t in terms & set(b):
                tf = b.count(t)
                m = 100 - 50 + 50 * len(b) * n_docs // n_terms
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 20 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(n, seed, vocabulary=400):
    r = random.Random(seed)
    word = lambda: f"w{int(vocabulary * r.random() ** 3)}"
    return [(i, " ".join(word() for _ in range(r.choice([1, 5, 30, 200])))) for i in range(n)]


def test_query_is_the_contract(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = QUERIES["op12_ranked_search"](spark, SF)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert rows(got) == brute(docs, items)


@pytest.mark.parametrize("k", [1, 7, 50])
def test_small_shards_and_blocks(spark, monkeypatch, k):
    monkeypatch.setattr(rs, "SHARD_BYTES", 9000)
    monkeypatch.setattr(rs, "BLOCK", 4)
    monkeypatch.setattr(rs, "QUERY_BLOCK", 5)
    docs, items = made(500, k), [(i, t) for i, t in made(23, 90 + k)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(rs.search(df, spark.createDataFrame(items, "item_id long, text string"), k)) == brute(docs, items, k)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "Abc ABC aBc"), (5, "É é É"), (5, "É é É"), (None, "abc é"), (6, "abc_def-é9"), (7, "日本 日本語 \U0001f600"),
            (8, "x " * 70_000 + "abc"), (9, "z" * 3_000_000), (10, "abc"), (11, "abc")]
    items = [(1, "abc"), (2, "É 日本"), (2, "x"), (None, "def zz"), (3, None), (4, ""), (5, "nowhere"), (6, "z" * 3_000_000), (7, "\U0001f600 9 é9")]
    d = spark.createDataFrame([(*r, 1, "t") for r in docs], "doc_id long, text string, item_id int, term string")
    q = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id int")
    assert rows(rs.search(d, q)) == brute(docs, items)
    assert rs.search(d.limit(0), q).collect() == [] and rs.search(d, q.limit(0)).collect() == []
    assert rs.search(d.filter("doc_id < 4"), q).collect() == []


def test_string_ids(spark):
    docs, items = [(f"d{i % 9}", t) for i, t in made(40, 3)], [(f"i{i}", t) for i, t in made(4, 5)]
    got = rs.search(spark.createDataFrame(docs, "doc string, body string"), spark.createDataFrame(items, "q string, body string"),
                    5, "doc", "body", "q", "body")
    ranks = {}
    for r in got.collect():
        ranks.setdefault(r.q, []).append((r.rank, -r.score, r.doc))
    for found in ranks.values():
        assert [x[0] for x in sorted(found)] == list(range(1, len(found) + 1))
        assert [x[1:] for x in sorted(found)] == sorted(x[1:] for x in found)


def test_pieces_cut_no_term(monkeypatch):
    text = " ".join(f"w{i}{'é' * (i % 40)}" for i in range(900)).encode()
    whole = rs.terms(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(rs, "HASH_BYTES", 64)
    small = rs.terms(np.frombuffer(text, np.uint8))
    assert all(np.array_equal(a, b) for a, b in zip(whole, small)) and len(whole[0]) == 900


def test_numbers_are_packed():
    r = np.random.default_rng(1)
    for top in (2, 127, 128, 129, 20_000, 2**31, 2**40):
        v = r.integers(0, top, 500)
        data, size = rs.pack(v)
        assert np.array_equal(rs.unpack(data), v) and size.sum() == len(data)


def test_blocks_are_skipped():
    """Non-essential lists are asked for few of their blocks, and the answer stays exact."""
    import pyarrow as pa
    r = random.Random(2)
    texts = [" ".join(["common"] * max(0, r.randint(-3, 4)) + [f"w{r.randint(0, 3000)}" for _ in range(r.randint(3, 40))] + ["rare"] * (i % 611 == 0)) for i in range(20_000)]
    bags = [words(t) for t in texts]
    corpus = rs.Corpus(len(texts), sum(map(len, bags)))
    batch = rs.shard_rows(list(range(len(texts))), [t.encode() for t in texts], corpus, pa.int64(), 0).to_pylist()
    norms = np.array(batch[-1]["norms"])
    by_term = {x["term"]: x for x in batch[:-1]}
    lists = []
    for term in ("common", "rare"):
        x = by_term[int(rs.terms(np.frombuffer(term.encode(), np.uint8))[0].view(np.int64)[0])]
        lists.append((corpus.weight(x["df"]), x["top"], rs.Postings(x["last"], x["peak"], x["ends"], x["body"], norms)))
    best, score = rs.top_documents(lists, len(texts), 10)
    common = lists[0][2]
    assert 0 < len(common.opened) < len(common.last) / 2
    assert [(0, i + 1, int(d), int(s)) for i, (d, s) in enumerate(zip(best, score))] == \
        sorted(brute(list(enumerate(texts)), [(0, "common rare")], 10), key=lambda x: x[1])
