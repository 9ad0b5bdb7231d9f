"""Tokenisation and lexicon lookup (M1, J6, F43-F47) as array expressions.

The reference runs a morphological analyser per post and keeps the base form of nouns,
adjectives, verbs, symbols and particles.  Here a post is split into script runs by one
regex (letters/digits of one script form a token; any other visible character is a
one-character symbol token), each token is looked up in a lexicon (surface ->
part of speech, base form) and the keep-list filter and base-form choice run on the
token array with higher-order functions — no shuffle, no Python, and the same code
works on a streaming DataFrame.  A lexicon too large for a map literal goes through
``lexicon_join`` (sent to the tasks, or a regular join on the exploded tokens).
"""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import STRIP_CLASS, sql_str

# Token pattern (Java).  Letters/digits outside Han, Hiragana and Katakana (with the
# long-vowel mark) form runs; Han, Hiragana and Katakana runs are separate tokens;
# anything else that is not white space is a symbol token of one character.  The
# alternatives are disjoint; the common (non-CJK) run is tried first.
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"
TOKEN_PATTERN = (r"[\p{L}\p{N}&&[^" + _CJK + r"]]+|\p{IsHan}+|\p{IsHiragana}+|[\p{IsKatakana}ー]+"
                 r"|[^\p{L}\p{N}" + STRIP_CLASS + r"]")
# RE2 twin for the oracle (equal to the Java pattern on text without CJK characters).
TOKEN_PATTERN_RE2 = r"[\p{L}\p{N}]+|[^\p{L}\p{N}" + STRIP_CLASS + r"]"

# The part-of-speech keep-list of the reference (noun, adjective, verb,
# symbol, particle) and the "no base form" marker.
KEEP_POS = ["noun", "adjective", "verb", "symbol", "particle"]
NO_BASE = "*"
LEXICON_BYTES = 32 << 20        # of a lexicon that is sent to the tasks

# Default lexicon (ours): closed-class words of the four languages in the data, with a
# part of speech and, for inflected verbs, a base form.  Unknown word tokens are nouns,
# unknown non-word tokens are symbols, both with no base form.
DEFAULT_LEXICON = {
    # determiners (dropped)
    "the": ("determiner", NO_BASE), "a": ("determiner", NO_BASE), "an": ("determiner", NO_BASE),
    "le": ("determiner", NO_BASE), "la": ("determiner", NO_BASE), "les": ("determiner", NO_BASE),
    "un": ("determiner", NO_BASE), "une": ("determiner", NO_BASE), "des": ("determiner", NO_BASE),
    "der": ("determiner", NO_BASE), "die": ("determiner", NO_BASE), "das": ("determiner", NO_BASE),
    "ein": ("determiner", NO_BASE), "eine": ("determiner", NO_BASE),
    "el": ("determiner", NO_BASE), "los": ("determiner", NO_BASE), "las": ("determiner", NO_BASE),
    "una": ("determiner", NO_BASE),
    # conjunctions (dropped)
    "and": ("conjunction", NO_BASE), "or": ("conjunction", NO_BASE), "but": ("conjunction", NO_BASE),
    "et": ("conjunction", NO_BASE), "ou": ("conjunction", NO_BASE), "und": ("conjunction", NO_BASE),
    "oder": ("conjunction", NO_BASE), "y": ("conjunction", NO_BASE), "que": ("conjunction", NO_BASE),
    # adverbs (dropped)
    "not": ("adverb", NO_BASE), "very": ("adverb", NO_BASE), "ne": ("adverb", NO_BASE),
    "pas": ("adverb", NO_BASE), "nicht": ("adverb", NO_BASE), "no": ("adverb", NO_BASE),
    # prepositions (kept, like particles)
    "of": ("particle", NO_BASE), "in": ("particle", NO_BASE), "to": ("particle", NO_BASE),
    "for": ("particle", NO_BASE), "with": ("particle", NO_BASE), "on": ("particle", NO_BASE),
    "de": ("particle", NO_BASE), "du": ("particle", NO_BASE), "en": ("particle", NO_BASE),
    "von": ("particle", NO_BASE), "mit": ("particle", NO_BASE), "con": ("particle", NO_BASE),
    "por": ("particle", NO_BASE), "para": ("particle", NO_BASE),
    # inflected verbs (kept as their base form)
    "is": ("verb", "be"), "are": ("verb", "be"), "was": ("verb", "be"), "were": ("verb", "be"),
    "has": ("verb", "have"), "had": ("verb", "have"),
    "est": ("verb", "être"), "sont": ("verb", "être"),
    "ist": ("verb", "sein"), "sind": ("verb", "sein"),
    "es": ("verb", "ser"), "son": ("verb", "ser"),
}


def tokenize(c) -> Column:
    """M1: script-run tokens of an already cleaned text (array<string>)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


def _map_lit(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def default_pos(tok: Column) -> Column:
    return F.when(tok.rlike(r"^[\p{L}\p{N}]"), F.lit("noun")).otherwise(F.lit("symbol"))


def base_forms(tokens, lexicon: dict | None = None, keep_pos=None) -> Column:
    """J6 + F45 + F46 on a token array: keep-listed parts of speech, base form unless
    the lexicon has none (`*`), then the surface.

    The lexicon is compiled to a drop set (surfaces whose part of speech is not kept;
    an ``isin`` that the optimizer turns into a hash-set lookup) and a base-form map for
    the kept surfaces that have one."""
    lexicon = DEFAULT_LEXICON if lexicon is None else lexicon
    keep = KEEP_POS if keep_pos is None else list(keep_pos)
    toks = F.col(tokens) if isinstance(tokens, str) else tokens
    drop = [s for s, (pos, _) in lexicon.items() if pos not in keep]
    base = {s: b for s, (pos, b) in lexicon.items() if pos in keep and b != NO_BASE}
    known = list(lexicon)

    def kept(t):
        in_drop = t.isin(drop) if drop else F.lit(False)
        if "noun" in keep and "symbol" in keep:        # unknown tokens are always kept
            return ~in_drop
        unknown_ok = default_pos(t).isin(keep) & ~(t.isin(known) if known else F.lit(False))
        return (~in_drop & (t.isin(known) if known else F.lit(False))) | unknown_ok

    out = F.filter(toks, kept)
    if base:
        bmap = _map_lit(base)
        out = F.transform(out, lambda t: F.coalesce(F.try_element_at(bmap, t), t))
    return out


def join_tokens(tokens) -> Column:
    """tokens joined with one space."""
    toks = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.array_join(toks, " ")


def feature_field(feature, i: int) -> Column:
    """field i of a comma-separated analyser feature string."""
    c = F.col(feature) if isinstance(feature, str) else feature
    return F.split(c, ",").getItem(i)


def _lexicon_words(parts: list, others: bool):
    """Function of an Arrow array of token lists: each token's word by one of ``parts`` (surface, word; null: not
    kept), and with ``others`` the tokens that none has."""
    def run(lists: pa.Array) -> pa.Array:
        from ..operators import lookup

        out = []
        for b in lookup.slices(pa.RecordBatch.from_arrays([lists], ["t"]), 0):
            bounds, tokens = lookup.offsets(b.column(0)), pc.list_flatten(b.column(0))
            words = tokens if others else pa.nulls(len(tokens), tokens.type)
            for part, place in lookup.places(tokens, parts):
                words = pc.if_else(place.is_valid(), part.column(1).cast(tokens.type).take(place), words)
            out.append(lookup.lists_of(words, words.is_valid().to_numpy(zero_copy_only=False), bounds))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return run


def lexicon_join(df: DataFrame, tokens_col: str, lexicon: DataFrame, keep_pos=None, out_col: str = "words") -> DataFrame:
    """J6 for a lexicon DataFrame (surface, pos, base) of any size: ``df`` with ``out_col``.

    A lexicon of at most ``LEXICON_BYTES`` is sent to the tasks, which look each row's tokens up
    where the row is.  With a larger one, and where that does not tell a token's word (a surface
    with several words, a keep-list that has only one of nouns and symbols), the distinct tokens of
    a post are joined to the lexicon on the surface (the planner and AQE choose how, from
    measured sizes), and what is found is put together per distinct token array as a map that
    each row looks its own tokens up in.  So rows are known by their tokens, not by an id, and
    every row comes back once.  A map holds one post's distinct tokens only."""
    from ..operators import lookup

    keep = KEEP_POS if keep_pos is None else list(keep_pos)
    pos = F.coalesce("pos", default_pos(F.col("surface")))
    word = F.when(F.coalesce("base", F.lit(NO_BASE)) == NO_BASE, F.col("surface")).otherwise(F.col("base"))
    entries = lexicon.filter(F.col("surface").isNotNull()).groupBy("surface").agg(F.collect_set(F.when(pos.isin(keep), word)).alias("words"))
    most, bytes_ = entries.agg(F.max(F.size("words")), F.sum(F.octet_length("surface") + F.coalesce(F.octet_length(F.try_element_at("words", F.lit(1))), F.lit(0)) + 16)).first()
    if ("noun" in keep) == ("symbol" in keep) and (most or 0) <= 1 and (bytes_ or 0) <= LEXICON_BYTES:
        parts, _ = lookup.head(entries.select("surface", F.try_element_at("words", F.lit(1)).alias("word")), "surface", ["word"], F.lit(0), 2 * LEXICON_BYTES)
        return df.withColumn(out_col, F.arrow_udf(_lexicon_words(parts, "noun" in keep), T.ArrayType(T.StringType()))(F.col(tokens_col)))
    rows = df.withColumn("_key", F.struct(F.xxhash64(tokens_col), F.size(tokens_col)))
    ex = rows.select("_key", F.explode(F.array_distinct(tokens_col)).alias("surface")).distinct()
    j = ex.join(lexicon.select("surface", "pos", "base"), "surface", "left")
    known = (j.filter(pos.isin(keep)).groupBy("_key")
             .agg(F.map_from_entries(F.collect_set(F.struct(F.col("surface"), word.alias("word")))).alias("_words")))
    out = rows.join(known, "_key", "left")
    found = F.transform(F.col(tokens_col), lambda t: F.try_element_at(F.col("_words"), t))
    words = F.coalesce(F.filter(found, lambda w: w.isNotNull()), F.array().cast("array<string>"))
    return out.withColumn(out_col, words).drop("_key", "_words")


def map_tagger(df: DataFrame, text_col: str, factory, keep_pos=None, out_col: str = "words") -> DataFrame:
    """A pluggable analyser run with ``mapInPandas``.

    ``factory()`` is called once per Python worker task (not per row) and returns
    ``tag(text) -> list[(surface, pos, base)]`` — e.g. a dictionary-based morphological
    analyser.  Each post keeps its keep-listed tokens, base form unless ``*``.  Rows stay
    in their partition (no shuffle); Arrow moves them in batches."""
    import pandas as pd

    keep = set(KEEP_POS if keep_pos is None else keep_pos)
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.ArrayType(T.StringType()))])

    def run(batches):
        tag = factory()
        for pdf in batches:
            words = []
            for text in pdf[text_col]:
                toks = [] if text is None else tag(text)
                words.append([surface if base == NO_BASE else base for surface, pos, base in toks if pos in keep])
            yield pdf.assign(**{out_col: pd.Series(words, index=pdf.index, dtype=object)})

    return df.mapInPandas(run, schema)


# ---------------------------------------------------------------- DuckDB twin
def sql_words(clean_expr: str, lexicon: dict | None = None, keep_pos=None) -> str:
    """Kept words (list<varchar>) of a cleaned text, as DuckDB SQL."""
    lexicon = DEFAULT_LEXICON if lexicon is None else lexicon
    keep = KEEP_POS if keep_pos is None else list(keep_pos)
    dflt = "CASE WHEN regexp_matches(t, '^[\\p{L}\\p{N}]') THEN 'noun' ELSE 'symbol' END"
    if lexicon:
        pos_case = "CASE t " + " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v[0])}" for k, v in lexicon.items()) \
            + f" ELSE {dflt} END"
        base_case = "CASE t " + " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v[1])}" for k, v in lexicon.items()
                                         if v[1] != NO_BASE) + " ELSE t END"
    else:
        pos_case, base_case = dflt, "t"
    keep_sql = ", ".join(sql_str(k) for k in keep)
    toks = f"regexp_extract_all({clean_expr}, {sql_str(TOKEN_PATTERN_RE2)})"
    tagged = f"list_transform({toks}, lambda t: {{'pos': {pos_case}, 'word': {base_case}}})"
    return f"list_transform(list_filter({tagged}, lambda s: s.pos IN ({keep_sql})), lambda s: s.word)"
