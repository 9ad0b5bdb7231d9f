"""Language identification with error-correcting output codes (operator 8).

Every language has a codeword; for each bit a binary n-gram classifier predicts whether a
text belongs to the languages with that bit set.  The classifiers are linear over hashed
1- to 3-grams of lower-cased letters (words are padded with a space): their weights are
smoothed log-odds of the n-gram counts of the two sides.  The counts are one aggregation
of the learning rows, a (buckets x languages) table of fixed size that the driver reads.

Decoding: the loss of a codeword is the sum over bits of w * log(1 + exp(-code * margin)),
w being how well the bit separates the learning rows.  The nearest codeword is the answer,
its share of exp(-loss) over all codewords the score; a small gap to the second nearest
flags the answer as ambiguous.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import handing_back

BUCKETS = 1 << 15            # of hashed n-grams
MAX_LANGUAGES = 256          # bounds the count table (BUCKETS x MAX_LANGUAGES) and codewords
MAX_EXHAUSTIVE = 5           # up to here every split of the languages is a bit
SMOOTHING = 0.5
SHARPNESS = 2.0              # margin per n-gram to loss
AMBIGUOUS_GAP = 0.1          # of the losses of the two nearest codewords
PIECE_CHARS = 1 << 18        # n-grams are counted in pieces of a text of this length
UNDETERMINED = "und"

# word characters that are no digits: letters, and signs like fractions that str.isalpha tells apart
_candidate = re.compile(r"[^\W\d_]").finditer


def _letter(text: str) -> bool:
    """Whether a text has a letter."""
    return any(m[0].isalpha() for m in _candidate(text))


_PAD = 32
_M = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def _letters() -> np.ndarray:
    """For each code point of the first plane: itself if a letter, else a space."""
    t = np.arange(0x10000, dtype=np.uint32)
    t[[i for i in range(0x10000) if not chr(i).isalpha()]] = _PAD
    return t


_TABLE: list[np.ndarray] = []


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of a text's letters."""
    if not _TABLE:
        _TABLE.append(_letters())
    out = np.zeros(BUCKETS, np.int64)
    shift = np.uint32(33 - BUCKETS.bit_length())
    low = text.lower()
    for at in range(0, max(1, len(low)), PIECE_CHARS):
        cp = np.frombuffer(low[max(0, at - 2):at + PIECE_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(cp < 0x10000, _TABLE[0][np.minimum(cp, 0xFFFF)], cp)
        # one space between words
        keep = c != _PAD
        keep[1:] |= keep[:-1]
        c = np.concatenate([[_PAD], c[keep], [_PAD]]).astype(np.uint32)
        grams = [c[c != _PAD] * _M[0]]
        two = c[:-1] * _M[1] ^ c[1:] * _M[0]
        grams.append(two[(c[:-1] != _PAD) | (c[1:] != _PAD)] + np.uint32(7))
        if len(c) > 2:
            three = (two[:-1] * _M[2] ^ c[2:] * _M[1])
            grams.append(three[c[1:-1] != _PAD] + np.uint32(11))
        g = np.concatenate(grams)
        g ^= g >> np.uint32(15)
        out += np.bincount((g * _M[2]) >> shift, minlength=BUCKETS)
    return out


def codewords(k: int) -> np.ndarray:
    """k codewords of +-1.  Few languages: all splits into two sides.  More: random dense
    words, of which the set with the largest least distance of 200 is taken."""
    if k == 1:
        return np.ones((1, 1))
    if k <= MAX_EXHAUSTIVE:
        bits = [[1] + [1 if x >> i & 1 else -1 for i in range(k - 1)] for x in range(2 ** (k - 1) - 1)]
        return np.array(bits, float).T
    length = int(np.ceil(12 * np.log2(k)))
    rng, best, far = np.random.default_rng(11), None, -1
    for _ in range(200):
        words = rng.choice([-1.0, 1.0], (k, length))
        apart = (length - words @ words.T) / 2 + length * np.eye(k)
        two_sided = (np.abs(words.sum(0)) < k).all()
        if two_sided and apart.min() > far:
            best, far = words, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray         # languages x bits
    weights: np.ndarray      # buckets x bits
    bias: np.ndarray         # bits
    bit_weights: np.ndarray  # bits

    def margins(self, counts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(counts)
        n = counts[at].astype(float)
        return (n @ self.weights[at] / max(1.0, n.sum())) * SHARPNESS + self.bias

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)"""
        if not self.languages or not text or not _letter(text):
            return UNDETERMINED, 0.0, True
        m = self.margins(ngram_counts(text))
        loss = np.logaddexp(0, -self.code * m) @ self.bit_weights
        order = np.argsort(loss, kind="stable")
        share = np.exp(loss[order[0]] - loss)
        gap = loss[order[1]] - loss[order[0]] if len(order) > 1 else np.inf
        return self.languages[order[0]], float(1 / share.sum()), bool(gap < AMBIGUOUS_GAP)


def learn(rows: DataFrame, text_col: str, lang_col: str) -> Model:
    """Model from rows with a text and a language (others are left out).  Languages are
    taken in the order of their code points; with no row there is no language, and every
    answer is ``und``."""
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull())

    languages = [r.lang for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages.sort(key=lambda s: s.encode("utf-32-be", "surrogatepass"))
    place = {x: i for i, x in enumerate(languages)}

    @handing_back

    def count(batches):
        total = np.zeros((len(place), BUCKETS), np.int64)
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                total[place[lang.as_py()]] += ngram_counts(text.as_py())
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(languages), BUCKETS))
    table[counts["lang"], counts["bucket"]] = counts["n"]
    return fit(languages, table)


def fit(languages: list[str], table: np.ndarray) -> Model:
    """Classifiers of all bits from the n-gram counts of each language.  Each language
    counts alike, whatever the number of its rows."""
    k = len(languages)
    if not k:
        return Model([], np.empty((0, 0)), np.empty((BUCKETS, 0)), np.empty(0), np.empty(0))
    code = codewords(k)
    smooth = table + SMOOTHING
    p = smooth / smooth.sum(1, keepdims=True)
    on, off = (code > 0).astype(float), (code < 0).astype(float)
    p_on = p.T @ on / np.maximum(on.sum(0), 1)
    p_off = p.T @ off / np.maximum(off.sum(0), 1)
    weights = np.log(np.maximum(p_on, 1e-12)) - np.log(np.maximum(p_off, 1e-12)) if k > 1 else np.ones((BUCKETS, 1))
    centre = p @ weights                      # mean margin of each language and bit
    high = np.where(code > 0, centre, np.inf).min(0)
    low = np.where(code < 0, centre, -np.inf).max(0)
    bias = -SHARPNESS * np.where(np.isfinite(high + low), (high + low) / 2, 0.0)
    apart = np.where(np.isfinite(high - low), np.maximum(high - low, 1e-3), 1.0)
    return Model(languages, code, weights, bias, apart / apart.mean())


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``language``: struct of lang_pred, score, ambiguous, from the
    text alone.  Null text or one without a letter: ``und``, 0, ambiguous.  Every row is
    kept; a column of that name in ``docs`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)   # BUCKETS x bits numbers, a fixed size

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        @handing_back
        def run(batches):
            m = shared.value
            for texts in batches:
                yield pd.DataFrame([m.decide(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

        yield from run(batches)

    return docs.withColumn("language", decide(F.col(text_col)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, and answer for all rows: id_col,
    held_out, lang_pred, score, ambiguous.  One row per input row (repeated rows and null
    ids too); an empty table gives an empty result."""
    model = learn(docs.filter(~held_out(id_col)), text_col, lang_col)
    out = predict(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")), model)
    return out.select(id_col, held_out(id_col).alias("held_out"), "language.*")
