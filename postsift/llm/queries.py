"""Registered queries of the operators: ``(spark, sf_dir) -> DataFrame`` over whole tables,
with production parameters.  The operators are general; digest columns are derived here."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.tables import table
from . import binary_search, byte_bpe, infill, language_id, licenses, mixing, packing, pii, quality, ranked_search, secrets, sentencepiece_codec, sharding
from .jaccard_join import jaccard_components

TOKENIZERS = "public_tokenizers"     # package whose path(name) gives a vocabulary file
PIECE_MODEL = "piece_bpe_32k.model"
SHARDS = 40
SOURCE_WEIGHTS = (5, 2, 1)
BYTE_VOCABULARY = "byte_bpe_50k.json"
OP11 = dict(capacity=1024, end_id=2)
RANKED = 50
QUERY_STEP, TOP_K = 50, 10
OP10 = dict(num=90, den=100)


def op10_jaccard_join(spark, sf):
    return jaccard_components(table(spark, sf, "documents"), **OP10).select("doc_id", "n_shingles", "component_id")


def tokenizer_path(name: str) -> str:
    import importlib
    return importlib.import_module(TOKENIZERS).path(name)


def op6_sentencepiece(spark, sf):
    model = sentencepiece_codec.load_model(tokenizer_path(PIECE_MODEL))
    return sentencepiece_codec.encode_digests(table(spark, sf, "documents"), model)


def op8_language_id(spark, sf):
    return language_id.identify(table(spark, sf, "documents"))


def op2_sharding(spark, sf):
    out = sharding.shard(table(spark, sf, "documents"), [1.0] * SHARDS, more_weights=[1.0])
    return out.withColumn("law", F.lit("key"))


def op4_source_mixing(spark, sf):
    return mixing.Mix(table(spark, sf, "documents"), SOURCE_WEIGHTS).taken()


def op1_pii(spark, sf):
    return pii.digests(table(spark, sf, "documents"))


def op3_quality_rules(spark, sf):
    return quality.judge(table(spark, sf, "documents"))


def op9_secrets(spark, sf):
    return secrets.digests(table(spark, sf, "documents"))


def op5_topk_search(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return binary_search.search(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0), k=TOP_K)


def op7_license_scan(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


def op11_pattern_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), byte_bpe.load(tokenizer_path(BYTE_VOCABULARY)), **OP11)


def op12_ranked_search(spark, sf):
    return ranked_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=RANKED)


def op13_fill_in_middle(spark, sf):
    return infill.digests(table(spark, sf, "documents"))


QUERIES = {
    "op11_pattern_packing": op11_pattern_packing,
    "op12_ranked_search": op12_ranked_search,
    "op13_fill_in_middle": op13_fill_in_middle,
    "op5_topk_search": op5_topk_search,
    "op7_license_scan": op7_license_scan,
    "op1_pii": op1_pii,
    "op3_quality_rules": op3_quality_rules,
    "op9_secrets": op9_secrets,
    "op2_sharding": op2_sharding,
    "op4_source_mixing": op4_source_mixing,
    "op8_language_id": op8_language_id,
    "op6_sentencepiece": op6_sentencepiece,
    "op10_jaccard_join": op10_jaccard_join,
}
