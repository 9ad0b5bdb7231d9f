"""The codec against the sentencepiece library, and the DataFrame operators."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as spm

from postsift.llm import sentencepiece_codec as sc

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sc.load_model(PATH)


def _varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def with_normaliser(model, charmap, dummy, trim):
    """The same model with another normaliser."""
    out = b""
    for number, value in sc._fields(model):
        if number == 3:
            value = _field(1, b"x") + _field(2, charmap) + _field(3, int(dummy)) + _field(4, int(trim)) + _field(5, 1)
        out += _field(number, value)
    return out


def charmap(rule):
    spec = spm.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    own = dict(sc._fields(spec))
    return dict(sc._fields(own[3]))[2]


TEXTS = ["", " ", "  ", "a", " a", "a ", "\n", "\n\n a\tb\r\n", "Hello, world!", "▁", "▁▁x", " ▁ a", "x" * 300, "aaaa " * 50,
         "日本語のテキスト", "😀😀 z😀", "naïve café", "<s> </s> <unk> <0x41>", "\u0000a\u0000", "ｱﾊﾟｰﾄ ①  ﬁ", "é x​ y﻿",
         "１２３　４５", "a b c", " " * 40 + "k", "the" * 200, "각 ㌔㌘", "İstanbul ß"]


def rand_texts(n):
    r = random.Random(5)
    pools = ["abcde fgh  ", "the and ing▁ \n\t", "éèß日本語😀ｱﾊﾟ①㌔ ́　", "".join(map(chr, range(32, 127)))]
    return ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 120))) for _ in range(n)]


def check(model_bytes, texts):
    lib = spm.SentencePieceProcessor(model_proto=model_bytes)
    own = sc.Codec(model_bytes)
    for t in texts:
        ids, begins, ends = own.encode(t)
        assert ids == lib.encode(t), t
        assert own.decode(ids) == lib.decode(ids), t
        for w in own.words(own.normalise(t)[0]):
            whole, used = own.word(w)
            own.learn([w])
            assert own.young[w] == (",".join(map(str, whole)), bytes(used), own.plain(whole)), w
        proto = lib.encode(t, return_type="proto")
        assert [(p.begin, p.end) for p in proto.pieces] == list(zip(begins, ends)), t


def test_same_as_library(model):
    check(model, TEXTS + rand_texts(600))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("dummy,trim", [(True, True), (True, False), (False, True), (False, False)])
def test_compiled_maps(model, rule, dummy, trim):
    blob = charmap(rule) if rule != "identity" else b""
    check(with_normaliser(model, blob, dummy, trim), TEXTS + rand_texts(150))


def test_merging_by_arrays_and_by_heap(model):
    own = sc.Codec(model)
    r = random.Random(1)
    words = ["".join(r.choice("theandigo ") for _ in range(r.randint(1, 90))).replace(" ", "") or "a" for _ in range(300)]

    def plain(w):
        s = list(w)
        while True:
            best = min(((own.rank[a + b], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in own.rank), default=None)
            if best is None:
                return s
            s[best[1]:best[1] + 2] = [s[best[1]] + s[best[1] + 1]]

    want = [plain(w) for w in words]
    assert [own.merge(w) for w in words] == want
    ids, count = own.merge_all(words)
    assert [own.pieces[i] for i in ids] == [p for w in want for p in w] and count.tolist() == list(map(len, want))


def test_windows_of_long_texts(model, monkeypatch):
    monkeypatch.setattr(sc, "TOGETHER", 40)
    check(model, TEXTS + rand_texts(200) + ["a b  c   d" * 100, "x" * 500, " " * 300])


def test_bad_bytes_decode_as_library(model):
    lib, own = spm.SentencePieceProcessor(model_proto=model), sc.Codec(model)
    r = random.Random(2)
    for _ in range(300):
        ids = [r.choice([r.randint(3, 258), r.randint(3, 31999), 0, 1]) for _ in range(r.randint(0, 12))]
        assert own.decode(ids) == lib.decode(ids), ids


def test_table_stays_bounded(model, monkeypatch):
    monkeypatch.setattr(sc, "REMEMBERED_WORDS", 10)
    check(model, rand_texts(100))


def test_operators(spark, model):
    texts = [None, "", "a b", "a b", "é\n" * 1000, "x" * 5000]
    df = spark.createDataFrame([(i if i != 3 else None, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    lib = spm.SentencePieceProcessor(model_proto=model)
    rows = sc.encode(df, model).collect()
    dig = sc.encode_digests(df, model).collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in dig] == [0, 1, 2, None, 4, 5]
    for t, r, d in zip(texts, rows, dig):
        ids = lib.encode(t or "")
        assert r.ids == ids and r.decoded == lib.decode(ids) and len(r.begins) == len(r.ends) == d.n_tokens == len(ids)
        assert d.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        assert d.spans_sha256 == hashlib.sha256(np.array(list(zip(r.begins, r.ends)), "<i8").tobytes()).hexdigest()
    assert sc.encode_digests(df.limit(0), model).count() == 0
