"""Sharding and mixing against their laws."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.llm import mixing, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").cache()


ODD = [(1, None), (2, ""), (2, ""), (None, "é"), (None, None), (3, "x" * 50_000), (-4, "same"), (5, "same")]


def test_shards(spark, docs):
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    out = sharding.shard(rows, [1.0] * 40, more_weights=[1.0]).toPandas()
    texts = [r.text for r in rows.collect()]
    assert sorted(zip(out["size"], out.text_crc32)) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
    for _, s in out.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert out.shard.between(0, 39).all()
    moved = out[out.shard != out.grown_shard]
    assert set(moved.grown_shard) <= {40} and 0 < len(moved) < len(out) / 10
    assert out.groupby("doc_id").shard.nunique().max() == 1


def test_shards_are_the_best_scores(spark):
    """Scores, winners and slots by plain arithmetic."""
    import math
    import struct

    import xxhash
    h = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    weights = [1.0, 2.5, 1.0, 0.5, 3.0]

    def plain(i, count):
        text = "-" if i is None else f"{len(str(i))}:{i}"
        key = struct.pack("<Q", h(text.encode()))
        u = [((h(struct.pack("<i", s), h(key)) >> 12) + 0.5) / 2 ** 52 for s in range(count)]
        return max(range(count), key=lambda s: (-weights[s] / math.log(u[s]), -s))

    ids = [None, 0, -5, 2**63 - 1, *range(100, 500)]
    df = spark.createDataFrame([(i, "t") for i in ids] + [(7, "same")] * 200, "doc_id long, text string")
    out = sharding.shard(df, weights[:4], more_weights=weights[4:]).collect()
    assert all((r.shard, r.grown_shard) == (plain(r.doc_id, 4), plain(r.doc_id, 5)) for r in out)
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_numbers_lie_between_0_and_1(spark):
    for h in (0, -1, 2**63 - 1, -2**63, 4095, -4096):
        u, x = spark.range(1).select(sharding.uniform(F.lit(h).cast("long")).alias("u"), (-1 / F.log(sharding.uniform(F.lit(h).cast("long")))).alias("x")).first()
        assert 0 < u < 1 and x > 0


def test_shard_depends_on_key_and_count_only(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(300)], "doc_id long, text string")
    b = a.filter("doc_id % 7 = 3").select("doc_id", F.lit("other").alias("text"), F.lit(1).alias("shard"), F.lit(2).alias("id"))
    one = {r.doc_id: r.shard for r in sharding.shard(a, [1.0] * 9).collect()}
    two = {r.doc_id: r.shard for r in sharding.shard(b, [1.0] * 9).collect()}
    assert all(one[k] == v for k, v in two.items())
    assert sharding.shard(a.limit(0), [1.0]).count() == 0
    assert {r.shard for r in sharding.shard(a, [2.0]).collect()} == {0}
    assert sharding.shard(a, [1.0]).first().grown_shard is None
    with pytest.raises(ValueError):
        sharding.shard_of(["doc_id"], [1.0, 0.0])


def test_shards_by_weight(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = sharding.shard(rows, [1.0, 2.0, 5.0]).groupBy("shard").count().toPandas().set_index("shard")["count"]
    assert np.allclose(n.loc[[0, 1, 2]] / 20_000, [1 / 8, 2 / 8, 5 / 8], atol=0.015)
    # more weight for one shard moves rows only into it
    a = {r.doc_id: r.shard for r in sharding.shard(rows, [1.0, 1.0, 1.0]).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard(rows, [1.0, 1.5, 1.0]).collect()}
    assert {b[k] for k in a if a[k] != b[k]} == {1}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_permutations(n):
    whole = mixing.permuted(np.arange(n), n, 1, 2)
    assert sorted(whole) == list(range(n))
    assert n < 20 or list(whole) != list(mixing.permuted(np.arange(n), n, 1, 3))
    assert list(mixing.permuted(np.arange(n)[::2], n, 1, 2)) == list(whole[::2])


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    t = mixing.targets([1, 100, 100], [5, 2, 1])
    assert t[0] == 3 and sum(t) == pytest.approx(201) and t[1] / t[2] == pytest.approx(2)
    assert mixing.targets([0, 4], [5, 2]) == [0, 4] and mixing.targets([], []) == [] and mixing.targets([0], [5]) == [0]


def test_counts_of_shards_add_up():
    quota = np.array([0, 7, 1000, 35, 1])
    first = np.zeros_like(quota)
    for k in range(-(-int(quota.sum()) // 64)):
        counts, start = mixing.shard_counts(quota, 64, k, 3)
        assert (start == first).all() and (counts >= 0).all()
        assert counts.sum() == min(64, quota.sum() - 64 * k)
        first = first + counts
    assert (first == quota).all()


def test_taken(spark, docs):
    odd = spark.createDataFrame([(900, None, None), (901, "", "src0"), (None, "a b c", None), (None, "a b c", None), (902, "one", "only")],
                                "doc_id long, text string, source string")
    rows = docs.unionByName(odd)
    mix = mixing.Mix(rows, (5, 2, 1))
    out = mix.taken().toPandas()
    assert len(out) == rows.count() and (out.taken <= 3 * out["size"]).all() and (out[out["size"] == 0].taken == 0).all()
    assert sorted(out["size"]) == sorted(len([w for w in _words(r.text)]) for r in rows.collect())
    big = out.groupby("target").agg(taken=("taken", "sum"), n=("source_size", "nunique"))
    for target, r in big.iterrows():
        assert abs(r.taken - r.n * target) <= 64 * r.n
    again = mixing.Mix(rows.repartition(5), (5, 2, 1)).taken().toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert out[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def _words(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mixed_documents(spark, docs):
    rows = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("row", F.lit(1)).withColumn("start", F.lit("x"))
    mix = mixing.Mix(rows, (5, 2, 1), block_words=16)
    out = mix.documents()
    assert out.columns == rows.columns and out.filter("n_chars <> length(text)").count() == 0
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(_words(r.text))
    assert words == {r.doc_id: r.taken for r in mix.taken().collect() if r.taken}


def test_copies():
    text = "a  b\nc d e"
    assert mixing.copies(text, 5, [(0, 2, 2), (2, 4, 3), (4, 5, 2)]) == [text, text, "c d"]
    assert mixing.copies(text, 5, [(0, 2, 1), (4, 5, 1)]) == ["a  b\ne"]
    assert mixing.copies(text, 5, [(0, 2, 1)]) == ["a  b"] and mixing.copies(text, 5, []) == []


def test_empty_mix(spark, docs):
    mix = mixing.Mix(docs.limit(0), (5, 2, 1))
    assert mix.taken().count() == 0 and mix.documents().count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.Mix(none, (5, 2, 1)).taken().orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
