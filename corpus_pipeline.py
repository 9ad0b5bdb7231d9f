"""Corpus pipeline: language ID, near duplicates, personal data, mixing, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.llm import language_id, mixing, pii, sentencepiece_codec
from postsift.llm.jaccard_join import keep_one
from postsift.llm.queries import PIECE_MODEL, SOURCE_WEIGHTS, tokenizer_path
from postsift.llm.scratch import Scratch
from postsift.plans.tables import table

# Session settings of the job: texts reach Python tasks in batches of bounded bytes, whatever
# the length of a document, so that a worker's memory does not depend on it.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
# Near duplicates: five-word shingles from a similarity of 0.8 on (operator 10 has its own parameters).
NEAR = dict(width=5, num=80, den=100)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is determined: not those without a letter, and
    not those that two languages fit about equally well."""
    model = language_id.learn(docs.filter(~language_id.held_out("doc_id")), "text", "lang")
    found = language_id.predict(docs, model)
    return found.filter((F.col("language.lang_pred") != language_id.UNDETERMINED) & ~F.col("language.ambiguous")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked documents."""
    return keep_one(docs, **NEAR).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; lengths follow the new texts."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document as often, and as far, as it is taken."""
    return mixing.Mix(docs, SOURCE_WEIGHTS).documents().select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text of the mix."""
    model = sentencepiece_codec.load_model(tokenizer_path(PIECE_MODEL))
    return sentencepiece_codec.encode_digests(docs, model)


def _stage(function):
    """``function`` with the settings of the job."""
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        return function(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _stage(identify_language)),
    ("near_duplicates", _stage(drop_near_duplicates)),
    ("pii", _stage(redact_personal_data)),
    ("source_mixing", _stage(mix_sources)),
    ("sentencepiece", _stage(encode_tokens)),
]

# Learned classifiers and seeded draws are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
