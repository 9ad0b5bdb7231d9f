"""Language ID, quality rules, licences and code search."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.llm import binary_search, language_id, licenses, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


# ---- language
def test_held_out_accuracy(spark, docs):
    out = {r.doc_id: r for r in language_id.identify(docs).collect()}
    rows = docs.collect()
    assert len(out) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {d for d, r in out.items() if r.held_out} == {r.doc_id for r in held}
    assert np.mean([out[r.doc_id].lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in out.values())


def test_answers_depend_on_text_alone(spark, docs):
    other = docs.withColumn("source", F.lit("z")).withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a = {r.doc_id: r.lang_pred for r in language_id.identify(docs.limit(300)).collect()}
    b = {r.doc_id: r.lang_pred for r in language_id.identify(other.limit(300)).collect()}
    assert a == b


def test_odd_texts(spark, docs):
    model = language_id.learn(docs, "text", "lang")
    assert model.languages == ["de", "en", "es", "fr"] and model.code.shape == (4, 7)
    odd = [(1, None), (2, ""), (3, "123 !?"), (None, "the and of that"), (4, "🙂"), (5, "the" * 200_000), (5, "the" * 200_000), (6, "\u0000")]
    df = spark.createDataFrame([(*o, 7) for o in odd], "doc_id long, text string, language int")
    out = [r.language for r in language_id.predict(df, model).collect()]
    assert [r.lang_pred == "und" for r in out] == [True, True, True, False, True, False, False, True]
    assert all(r.score == 0 and r.ambiguous for r in out if r.lang_pred == "und")
    none = language_id.learn(docs.limit(0), "text", "lang")
    assert none.decide("the") == ("und", 0.0, True)
    one = language_id.fit(["en"], np.ones((1, language_id.BUCKETS)))
    assert one.decide("words")[0] == "en"
    assert language_id.identify(docs.limit(0)).count() == 0


def test_number_signs_are_no_letters(spark, docs):
    model = language_id.fit(["en", "fr"], __import__("numpy").ones((2, language_id.BUCKETS)))
    for text in ("½ ②", "Ⅷ ²", "12 _ !", "", None):
        assert model.decide(text) == ("und", 0.0, True)
    assert model.decide("½ a")[0] == "en"


def test_decoding_is_the_plain_one(docs):
    """Answers by loops over bits and codewords."""
    import numpy as np
    r = np.random.default_rng(4)
    for k in (2, 4, 7):
        model = language_id.fit([f"l{i}" for i in range(k)], r.integers(0, 50, (k, language_id.BUCKETS)).astype(float))
        for text in ("the quick brown fox", "a", "les chats et les chiens " * 40):
            counts = language_id.ngram_counts(text)
            total, losses = counts.sum(), []
            for word in model.code:
                loss = 0.0
                for bit, sign in enumerate(word):
                    margin = language_id.SHARPNESS * sum(counts[b] * model.weights[b, bit] for b in np.flatnonzero(counts)) / total + model.bias[bit]
                    loss += model.bit_weights[bit] * np.log1p(np.exp(-sign * margin))
                losses.append(loss)
            best = int(np.argmin(losses))
            lang, score, ambiguous = model.decide(text)
            assert lang == f"l{best}" and abs(score - 1 / sum(np.exp(losses[best] - x) for x in losses)) < 1e-9
            assert ambiguous == (sorted(losses)[1] - losses[best] < language_id.AMBIGUOUS_GAP)


def test_mixture_is_ambiguous(docs):
    """Half of one language and half of another: some texts are flagged, most get a low
    score; texts of one language are not flagged."""
    model = language_id.learn(docs, "text", "lang")
    by = {x: [r.text.split()[:150] for r in docs.collect() if r.lang == x and r.n_chars > 1000][:80] for x in ("en", "fr")}
    pure = [model.decide(" ".join(w)) for x in by for w in by[x]]
    mixed = [model.decide(" ".join(a[:75] + b[:75])) for a, b in zip(by["en"], by["fr"])]
    assert sum(p[2] for p in pure) <= 1 and np.median([p[1] for p in pure]) > 0.999
    assert any(m[2] for m in mixed) and np.median([m[1] for m in mixed]) < 0.98


def test_pieces_of_long_texts(monkeypatch):
    text = "The quick brown föx, jumps over 12 dogs. " * 200
    whole = language_id.ngram_counts(text).sum()
    monkeypatch.setattr(language_id, "PIECE_CHARS", 97)
    assert abs(language_id.ngram_counts(text).sum() - whole) < 0.1 * whole


@pytest.mark.parametrize("k", [2, 3, 4, 5, 6, 20])
def test_codewords_are_apart(k):
    c = language_id.codewords(k)
    far = min(int((c[i] != c[j]).sum()) for i in range(k) for j in range(i))
    assert far >= (2 ** (k - 2) if k <= 5 else 5)


# ---- quality
def plain_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    at = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(at)


ODD_TEXTS = ["", " ", "\n\n\n", "a b c d e f g h a b c d e f g h", "x " * 30, "é日\x85本 #*$%&|<> é", "line\nline\n line\nline\n\n\n", "w" * 70_000,
             "a\x1cb c\x0bd", "🙂 🙂\n🙂 🙂\r\n🙂 🙂\r"]


def test_stats(docs):
    for t in [r.text for r in docs.limit(300).collect()] + ODD_TEXTS:
        assert quality.stats(t)[:5] == plain_stats(t), t[:100]
    assert quality.stats(None) == (0,) * len(quality.STATS)


def test_verdicts(spark, docs):
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(None, None), (None, ""), *[(5000 + i, t) for i, t in enumerate(ODD_TEXTS)]], "doc_id long, text string"))
    out = quality.judge(rows.withColumn("votes", F.lit("x")).withColumn("quality", F.lit(1))).collect()
    texts = {}
    for r in rows.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert len(out) == rows.count()
    for r in out:
        if r.doc_id is not None:
            n, *_, rep = plain_stats(texts[r.doc_id][0] or "")
            assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.kept and r.base_failed) and 0 <= r.quality <= 1
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in out if r.doc_id in labels and not r.base_failed]
    assert np.mean([k for q, k in judged if q == 1]) > 0.99
    assert np.mean([k for q, k in judged if q == 0]) < 0.2
    assert quality.judge(rows.limit(0)).count() == 0


def test_em_finds_accuracies():
    r = np.random.default_rng(1)
    good = r.random(20_000) < 0.8
    how = [(0.05, 0.1, 0.85, 0.7, 0.1, 0.2), (0.01, 0.01, 0.98, 0.5, 0.1, 0.4), (0.02, 0.5, 0.48, 0.4, 0.5, 0.1)]
    votes = np.stack([np.where(good, r.choice([-1, 0, 1], 20_000, p=h[:3]), r.choice([-1, 0, 1], 20_000, p=h[3:])) for h in how], 1)
    patterns, times = np.unique(votes, axis=0, return_counts=True)
    got, share, _ = quality.fit(patterns, times.astype(float))
    assert abs(share - 0.8) < 0.06
    for g, h in zip(got, how):
        assert np.allclose(g[0], h[:3], atol=0.06)


def test_votes_round_trip():
    v = np.array([[-1, 0, 1] * 3 + [1], [1] * 10, [-1] * 10])[:, :len(quality.RULES)]
    packed = np.zeros(3, np.int64)
    for j in range(v.shape[1]):
        packed = packed * 3 + v[:, j] + 1
    assert (quality.unpack(packed) == v).all()


# ---- licences
def plain_license(text):
    best = (None, None, 0)
    for unit in set([text, *re.split(r"\n[ \t\n\v\f\r]*\n", text), *text.split("\n")]):
        hit = False
        w = re.findall("[a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in unit))
        a = set(zip(w, w[1:]))
        for name, t in licenses.TEMPLATES.items():
            tw = re.findall("[a-z0-9]+", t.lower())
            b = set(zip(tw, tw[1:]))
            if a and 100 * 2 * len(a & b) >= 80 * (len(a) + len(b)):
                hit = True
                d = 2.0 * len(a & b) / (len(a) + len(b))
                if best[0] is None or d > best[1] or d == best[1] and name < best[0]:
                    best = (name, d, best[2])
        best = (best[0], best[1], best[2] + hit)
    return best


def test_licences(spark):
    r = random.Random(2)
    texts = [None, "", "a", "\n\n", "MIT", licenses.TEMPLATES["MIT"].upper(), "x\n\n" + licenses.TEMPLATES["BSD-3-Clause"] + "\n \n tail",
             "words here.\nReleased under the MIT License.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0"]
    for t in licenses.TEMPLATES.values():
        for _ in range(3):
            w = t.split()
            for _ in range(r.randint(0, max(1, len(w) // 8))):
                w[r.randrange(len(w))] = "changed"
            texts.append("Intro text\n" + " ".join(w) + "\nend")
    df = spark.createDataFrame([(None if i == 3 else i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    out = [(r.license, r.score, r.n_units) for r in licenses.scan(df).collect()]
    assert out == [plain_license(t or "") for t in texts]
    assert out[5][0] == "MIT" and out[6][0] == "BSD-3-Clause" and out[7] == ("CC-BY-NC-4.0-notice", 1.0, 2)
    assert licenses.scan(df.limit(0)).count() == 0


def plain_runs(text):
    """(coefficient, name) of the best run of sentences, all of them compared."""
    parts = [re.findall("[a-z0-9]+", p.lower()) for p in re.split(r"\n|(?<=[.!?;:])[ \t\n\v\f\r]+", text)]
    best = None
    for name, t in licenses.TEMPLATES.items():
        tw = re.findall("[a-z0-9]+", t.lower())
        b = set(zip(tw, tw[1:]))
        for i in range(len(parts)):
            w = []
            for j in range(i, len(parts)):
                w = w + parts[j]
                a = set(zip(w, w[1:]))
                d = 2.0 * len(a & b) / (len(a) + len(b))
                if a and 100 * 2 * len(a & b) >= 80 * (len(a) + len(b)) and (best is None or (-d, name) < best):
                    best = -d, name
    return (best[1], -best[0]) if best else (None, None)


def broken_up(template, r, width):
    """The template in paragraphs at its sentences, lines of ``width`` words."""
    out = []
    for sentence in re.split(r"(?<=[.:])[ ]", template):
        w = sentence.split()
        out.append("\n".join(" ".join(w[k:k + width]) for k in range(0, len(w), width)))
    return "\n \n".join(out)


def test_licences_in_several_paragraphs_of_long_texts():
    r = random.Random(12)
    scan = licenses.Scanner(licenses.TEMPLATES).scan
    some = lambda n: " ".join(f"w{r.randint(0, 500)}" + ("." if r.random() < 0.1 else "") for _ in range(n))
    for name, t in licenses.TEMPLATES.items():
        if len(t) > 200:
            for inside in (broken_up(t, r, 9), broken_up(t, r, 1000), "A sentence of the readme. " + t + " " + some(60)):
                text = inside + "\n\n" + some(400)
                for text in (text, some(300) + ".\n" + text):
                    assert scan(text)[0] == name and scan(text)[1] > 0.95 and scan(text)[2] == 1, (name, text)
    for _ in range(60):
        text = some(r.randint(0, 40)) + "\n"
        for _ in range(r.randint(1, 2)):
            w = broken_up(r.choice(list(licenses.TEMPLATES.values())), r, r.choice((5, 12, 1000))).split(" ")
            for _ in range(r.randint(0, max(1, len(w) // 8))):
                w[r.randrange(len(w))] = r.choice(("changed", "changed.", "\n", "the"))
            text += " ".join(w) + r.choice((" ", "\n", "\n\n")) + some(r.randint(0, 40)) + "\n"
        assert scan(text)[:2] == plain_runs(text), text
    mit = broken_up(licenses.TEMPLATES["MIT"], r, 9)
    assert scan(f"{mit}\n\n{some(300)}\n\n{broken_up(licenses.TEMPLATES['ISC'], r, 9)}\n\n{some(300)}\n\n{mit}")[2] == 2
    assert scan(mit + "\n" + "of the Software\n" * 10_000)[0] == "MIT"


# ---- code search
def plain_search(vectors, queries, k, bits):
    def code(v):
        return [v[i] is not None and v[i] > 0 if i < len(v) else False for i in range(bits)]
    known = [(i, code(v)) for i, v in vectors if i is not None and v is not None]
    out = []
    for q, v in queries:
        if q is not None and v is not None:
            c = code(v)
            near = sorted((sum(a != b for a, b in zip(c, o)), i) for i, o in known)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("bits,segments,k", [(64, 4, 10), (32, 4, 3), (128, 8, 5)])
def test_code_search(spark, bits, segments, k):
    r = np.random.default_rng(bits)
    centres = r.normal(size=(6, bits))
    vectors = [(i, (centres[i % 6] + r.normal(size=bits) * (i % 4)).tolist()) for i in range(150)]
    vectors += [(200 + i, vectors[7][1]) for i in range(30)]                    # a group of equal codes
    vectors += [(300, None), (None, vectors[0][1]), (301, []), (302, [float("nan")] * bits), (303, [None, 1.0]), (7, vectors[7][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("code", F.lit(1))
    q = df.filter("vec_id % 25 = 0 or vec_id is null or vec_id >= 300")
    out = sorted((r.query_id, r["rank"], r.neighbor_id, r.distance)
                 for r in binary_search.search(df, q, k=k, bits=bits, segments=segments).collect())
    assert out == plain_search(vectors, [v for v in vectors if v[0] is None or v[0] % 25 == 0 or v[0] >= 300], k, bits)


@pytest.mark.parametrize("dims", [96, 128])
def test_code_search_over_long_vectors(spark, dims):
    """Every component counts; a width that is too small is refused."""
    r = __import__("random").Random(dims)
    base = [r.gauss(0, 1) for _ in range(dims)]
    vectors = [(i, [x if j < 64 or r.random() < .7 else -x for j, x in enumerate(base)]) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    out = sorted(tuple(x) for x in binary_search.search(df, df.filter("vec_id % 20 = 0"), k=5).collect())
    assert out == plain_search(vectors, [v for v in vectors if v[0] % 20 == 0], 5, dims)
    with pytest.raises(ValueError):
        binary_search.search(df, df, k=5, bits=64)


def test_code_search_of_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0]), (2, [-1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in binary_search.search(df, df, k=5, bits=8, segments=2).collect()) == [(1, 1, 1, 0), (1, 2, 2, 2), (2, 1, 2, 0), (2, 2, 1, 2)]
    assert binary_search.search(df.limit(0), df, k=5, bits=8, segments=2).count() == 0
    assert binary_search.search(df, df.limit(0), k=5, bits=8, segments=2).count() == 0
