"""Best-fit packing: tokens by the library, every piece in its place, few sequences."""
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postsift.llm import byte_bpe, packing
from postsift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def own():
    return byte_bpe.load(VOCABULARY)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, docs, library, capacity):
    """Pieces cover each document by the rule, and the sequences without gap or overlap."""
    want = []
    for d, t in docs:
        ids = ids_of(library, t)
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in rows), key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(by) == list(range(len(by)))
    tokens = sum(w[3] for w in want)
    return len(by), -(-tokens // capacity)


def test_query_is_the_contract(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_pattern_packing"](spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n, least = check(got.collect(), docs, library, 1024)
    assert n <= least * 1.01 + 1


ODD = [(1, None), (2, ""), (3, "a"), (4, "word " * 5000), (4, "word " * 5000), (None, "x y"), (None, "x y"), (5, "z" * 200_000), (6, "é日本\U0001f600 \r\n\t  x"),
       (7, "a <|endoftext|> b<|endoftext|>"), (8, " " * 3000)] + [(9, "the same row")] * 400


def test_odd_rows(spark, library, own):
    df = spark.createDataFrame([(*r, 1, 2) for r in ODD], "doc_id long, text string, length int, task int").repartition(3)
    packed = packing.pack(df, own, 100, keep_ids=True).cache()
    check(packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect(), ODD, library, 100)
    texts = {}
    for s in packing.sequences(packed).collect():
        assert len(s.ids) == sum(p.length for p in s.parts) <= 100
        for p in s.parts:
            texts.setdefault((p.doc_id, p.piece), []).append(s.ids[p.offset:p.offset + p.length])
    whole = [i for p in range(51) for i in texts[(4, p)][0]] if (4, 50) in texts else []
    assert whole == ids_of(library, "word " * 5000) or not whole
    assert packing.pack(df.limit(0), own).collect() == []


def test_plan_places_every_piece():
    r = np.random.default_rng(5)
    for capacity in (7, 64, 256):
        for _ in range(25):
            counts = r.integers(0, r.choice([2, 30, 5000]), capacity + 1) * (r.random(capacity + 1) < r.random())
            counts[0] = 0
            made = packing.plan(counts.copy(), capacity)
            used = np.zeros(capacity + 1, np.int64)
            for lengths, n in made.groups:
                assert n > 0 and 0 < sum(lengths) <= capacity
                np.add.at(used, list(lengths), n)
            assert np.array_equal(used, counts)
            least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
            most = sum(n for _, n in packing.best_fit(counts, capacity))
            assert least <= made.sequences <= most * 1.01 + 2


def test_fit_is_least_squares():
    """A histogram made of patterns is fitted, and the conditions of the optimum hold."""
    r = np.random.default_rng(8)
    capacity = 60
    counts = r.integers(1, 400, capacity + 1)
    counts[[0, capacity]] = 0
    columns = packing.patterns(counts, capacity)
    assert (columns.sum(1) == capacity).all() and len(np.unique(columns, axis=0)) == len(columns)
    chosen, x = packing.fit(columns, counts)
    weight = np.arange(capacity + 1) / capacity
    matrix = np.zeros((capacity + 1, len(columns)))
    for c, row in enumerate(columns):
        for v in row[row > 0]:
            matrix[v, c] += weight[v]
    full = np.zeros(len(columns))
    full[chosen] = x
    gradient = matrix.T @ (counts * weight - matrix @ full)
    assert (x > 0).all() and np.abs(gradient[chosen]).max() < 1e-3 and gradient.max() < 1e-2 * counts.max()
    made = np.zeros(capacity + 1, np.int64)
    for row in columns[r.choice(len(columns), 12)]:
        np.add.at(made, row[row > 0], 50)
    chosen, x = packing.fit(packing.patterns(made, capacity), made)
    assert packing.plan(made, capacity).sequences <= 12 * 50 + 3


def test_encoding_is_the_library_s(library, own):
    encode, r = own.encoder(), random.Random(3)
    signs = ["a", "B", "é", "日", "\U0001f600", " ", "  ", "\n", "\t", "1", "23", "'s", "'LL", "!", "...", "‍", "\x85", "\x00", "<|endoftext|>", "́", "ß"]
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 25)))
        assert encode(text) == library.encode(text, add_special_tokens=False).ids, text
