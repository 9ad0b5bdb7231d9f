"""The pipeline's stages against brute force, and the registration of the queries."""
import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece as spm

import __spark_entry__ as E
import corpus_pipeline as cp
from postsift.llm import language_id, mixing, pii
from postsift.llm.oracle import ORACLE
from postsift.llm.queries import QUERIES
from postsift.plans.verify import compare, duck

from .test_jaccard_join import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """documents of sf0.001 with odd rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    base = docs.orderBy("doc_id").first().text
    odd = [(9000, None, "en", "src0", None), (9001, "", "en", "src0", 0), (9002, "12 34 !", "en", None, 7), (None, base + " one more", "fr", None, 1),
           (None, "lonely words of the and with a@b.co inside", None, "src1", 5), (9003, base, "fr", "src2", 9), (9003, base, "fr", "src2", 9)]
    path = str(tmp_path_factory.mktemp("sf"))
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(path + "/documents.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output rows of each stage."""
    docs, out = spark.read.parquet(sf_dir + "/documents.parquet"), {}
    for i, (name, stage) in enumerate(cp.STAGES):
        path = f"{sf_dir}/stage{i}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs, after
        docs = after
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "pii", "source_mixing", "sentencepiece"]
    for name, _ in cp.STAGES[:-1]:
        assert stages[name][1].columns == COLUMNS


def test_language_stage(spark, stages):
    before, after = stages["language_id"]
    model = language_id.learn(before.filter(~language_id.held_out()), "text", "lang")
    want = [r for r in rows(before) if r[1] and any(map(str.isalpha, r[1])) and not model.decide(r[1])[2]]
    assert sorted(map(str, rows(after))) == sorted(map(str, want))
    assert {9000, 9001, 9002}.isdisjoint({r.doc_id for r in after.collect()})


def test_near_duplicate_stage(stages):
    """The rule of the stage: five words, 0.8."""
    before, after = stages["near_duplicates"]
    b = rows(before)
    groups = {}
    for r, (_, n, c) in zip(b, brute([(r[0], r[1]) for r in b], **cp.NEAR)):
        groups.setdefault(c if c is not None else r[1], []).append(r)
    want = {str(min(g, key=lambda r: (r[0] is None, r[0] or 0, r[1]))) for g in groups.values()}
    got = [str(r) for r in rows(after)]
    assert set(got) == want and len(got) == len(want) < len(b)


def test_near_duplicates_are_of_five_words_and_08(spark):
    """Copies between the rule of operator 10 and that of the stage, and just under the latter."""
    r = random.Random(8)
    texts = []
    for _ in range(10):
        base = [f"w{r.randint(0, 3000)}" for _ in range(100)]
        middle = base[:50] + ["new"] + base[51:]
        texts += [base, base[:78], base[:82], base + [f"n{i}" for i in range(20)], base[:52], base[:52][:25] + ["new"] + base[26:52],
                  middle, base[:20] + ["a"] + base[21:60] + ["b"] + base[61:], base[:8], base[4:12]]
    texts = [" ".join(t) for t in texts]

    def five(text):
        w = text.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets, up = [five(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]) and up[i] != up[j]:
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(x.doc_id for x in dict(cp.STAGES)["near_duplicates"](spark, docs, "").collect())
    assert got == sorted(set(up)) and got != sorted({c for _, _, c in brute(list(enumerate(texts)))})


def test_pii_stage(stages):
    before, after = stages["pii"]
    want = [(d, pii.redact(t), lang, s, len(pii.redact(t))) for d, t, lang, s, _ in rows(before)]
    assert sorted(map(str, rows(after))) == sorted(map(str, want))
    assert not any("@b.co" in r[1] for r in rows(after))


def test_mixing_stage(spark, stages):
    before, after = stages["source_mixing"]
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    taken = {}
    for r in rows(after):
        taken[r[0]] = taken.get(r[0], 0) + count(r[1])
        assert r[4] == len(r[1])
    assert taken == {r.doc_id: r.taken for r in mixing.Mix(before, (5, 2, 1)).taken().collect() if r.taken}
    texts = {}
    for r in rows(before):
        texts.setdefault(r[0], set()).add(r[1])
    for r in rows(after):           # every line that was cut out stands in its document
        assert any(r[1] == t or all(part in t for part in r[1].split("\n")) for t in texts[r[0]])


def test_token_stage(stages):
    before, after = stages["sentencepiece"]
    lib = spm.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t, *_ in rows(before):
        ids = lib.encode(t)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, [r[:4] for r in rows(after)])) == sorted(map(str, want))


def test_run_is_the_stages(spark, sf_dir, stages):
    assert sorted(map(str, rows(cp.run(spark, sf_dir)))) == sorted(map(str, rows(stages["sentencepiece"][1])))


def test_registration():
    assert set(QUERIES) <= set(E.queries()) and "pipeline" in E.queries()
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    rep = compare(QUERIES[name](spark, SF), duck(SF), ORACLE[name])
    assert rep["ok"] and not rep.get("type_mismatch"), rep
