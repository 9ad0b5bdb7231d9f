"""Quality rules as weak supervision (operator 3).

Each rule votes good (+1) or bad (-1) on a text, or abstains (0).  Votes have no known
accuracy: expectation-maximisation over all documents estimates how each rule votes on
good and on bad documents, with a latent quality per document, and the posterior
probability of good quality replaces a conjunction of thresholds.

Documents with the same votes are alike to the model, so it is fitted on counts of vote
patterns: one aggregation over all rows to at most 3 ** len(RULES) rows, which is what the
driver reads and what is broadcast back.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, mix, utf8, word_hashes
from .scratch import Scratch
from .memory import handing_back

# Frequent function words of the languages that the rules know.
STOP_WORDS = ("the of and to in is that it was for on with as be by this are from "
              "de la le les et des en un une du que qui est pour dans "
              "der die und den das ist ein eine zu mit von nicht auf "
              "el los las por una con para se del no").split()
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
LINE_ENDS = tuple(".!?:;\"'…»”)")
REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
KEEP_FROM = 0.5

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_letters", "n_upper", "n_stop", "n_again")


def _votes(good, bad):
    return np.where(bad, -1, np.where(good, 1, 0))


def _ratio(a, b):
    return a / np.maximum(b, 1)


# name -> votes of the columns of stats
RULES: dict[str, Callable[[pd.DataFrame], np.ndarray]] = {
    "length": lambda s: _votes(s.n_words >= 50, s.n_words < MIN_WORDS),
    "word_length": lambda s: _votes((r := _ratio(s.word_chars, s.n_words)).between(3, 10), (r < 2) | (r > 14)),
    "symbols": lambda s: _votes((r := _ratio(s.n_symbols, s.word_chars)) < 0.01, r > 0.05),
    "dup_lines": lambda s: _votes((r := _ratio(s.n_dup_lines, s.n_lines)) < 0.05, r > 0.4),
    "repeats": lambda s: _votes((r := _ratio(s.n_repeat_words, s.n_words)) < 0.05, r > 0.25),
    "letters": lambda s: _votes((r := _ratio(s.n_letters, s.word_chars)) > 0.9, r < 0.7),
    "stop_words": lambda s: _votes((r := _ratio(s.n_stop, s.n_words)) > 0.05, (r < 0.005) & (s.n_words >= 30)),
    "upper_case": lambda s: _votes((r := _ratio(s.n_upper, s.n_letters)) < 0.2, r > 0.4),
    "stutter": lambda s: _votes((r := _ratio(s.n_again, s.n_words)) < 0.02, r > 0.2),
    "sentences": lambda s: _votes((r := _ratio(s.n_ended, s.n_lines)) > 0.5, r < 0.1),
}

_stop = np.unique(np.concatenate([word_hashes(f"{w} {w.capitalize()}", lower=False) for w in STOP_WORDS]))


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _SPACE = _table(SYMBOLS), _table(SPACES)
_UPPER, _LETTER = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))
_STARTS = ~_table(bytes(range(0x80, 0xC0)))      # every byte that begins a code point


def repeated_words(words: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words in windows of ``window`` that occur at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, U)
    for j in range(window):
        h = mix(h * U(0xD6E8FEB86659FD93) + words[j:j + n])
    _, which, times = np.unique(h, return_inverse=True, return_counts=True)
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(times[which] > 1)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def stats(text: str | None) -> tuple[int, ...]:
    """STATS of one text (all 0 for null)."""
    if not text:
        return (0,) * len(STATS)
    b = np.frombuffer(utf8(text), np.uint8)
    words = word_hashes(text, lower=False)
    seen, dup, lines, ended = set(), 0, 0, 0
    for line in text.split("\n"):
        bare = line.strip(" \t\x0b\x0c\r")
        if bare:
            lines += 1
            ended += bare.endswith(LINE_ENDS)
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (len(words), int(np.count_nonzero(_STARTS[b] & ~_SPACE[b])), int(np.count_nonzero(_SYMBOL[b])), dup, repeated_words(words),
            lines, ended, int(np.count_nonzero(_LETTER[b])), int(np.count_nonzero(_UPPER[b])), int(np.count_nonzero(np.isin(words, _stop))), int(np.count_nonzero(words[1:] == words[:-1])))


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, STATS, and the votes as one number (base 3)."""
    @handing_back
    def run(batches):
        for b in batches:
            s = pd.DataFrame([stats(t.as_py()) for t in b.column(1)], columns=STATS, dtype="int64")
            votes = np.zeros(len(s), np.int64)
            for rule in RULES.values():
                votes = votes * 3 + rule(s) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(s[c]) for c in STATS], pa.array(votes)], ["id", *STATS, "votes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, " + ", ".join(f"{c} long" for c in STATS) + ", votes long")


def unpack(votes: np.ndarray) -> np.ndarray:
    """Votes (-1, 0, 1) by row and rule."""
    k = len(RULES)
    return np.stack([votes // 3 ** (k - 1 - j) % 3 - 1 for j in range(k)], axis=1)


# Prior votes (bad, abstain, good) of any rule on good and on bad documents.
PRIOR_GOOD, PRIOR_BAD = np.array([0.2, 2.0, 8.0]), np.array([3.0, 2.0, 5.0])


def fit(votes: np.ndarray, times: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float, np.ndarray]:
    """How each rule votes on good and on bad documents (rules x 2 x 3: probabilities of
    bad, abstain, good), the share of good documents, and the posterior of each pattern.

    A rule has its own accuracy on either class: a rule that seldom calls anything bad says
    much when it does, and little when it does not.  The start takes documents without a
    bad vote for good; the priors keep the classes from changing places."""
    cast = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)     # patterns x rules x 3
    posterior = np.where((votes < 0).any(axis=1), 0.2, 0.95)
    for _ in range(rounds):
        on_good = np.einsum("p,prv->rv", times * posterior, cast) + PRIOR_GOOD
        on_bad = np.einsum("p,prv->rv", times * (1 - posterior), cast) + PRIOR_BAD
        how = np.stack([on_good / on_good.sum(1, keepdims=True), on_bad / on_bad.sum(1, keepdims=True)], axis=1)
        good = float(np.clip((times @ posterior + 7) / (times.sum() + 10), 0.05, 0.98))
        odds = np.log(good / (1 - good)) + np.einsum("prv,rv->p", cast, np.log(how[:, 0]) - np.log(how[:, 1]))
        was, posterior = posterior, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(posterior - was).max(initial=0) < 1e-9:
            break
    return how, good, posterior


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, quality (the posterior).

    Null or empty texts have no words and fail.  One row per input row, repeated rows and
    null ids included (equal texts get equal verdicts); other columns are ignored; an empty
    table gives an empty result."""
    spark = docs.sparkSession
    rows = Scratch(spark, "quality").keep(measured(docs, id_col, text_col), "stats")
    counts = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").toPandas()
    _, _, posterior = fit(unpack(counts["votes"].to_numpy()), counts["n"].to_numpy().astype(float))
    table = spark.createDataFrame([(int(v), float(p)) for v, p in zip(counts["votes"], posterior)], "votes long, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = rows.join(F.broadcast(table), "votes")       # at most 3 ** len(RULES) rows
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & (F.col("quality") >= KEEP_FROM)).alias("kept"), "quality")
