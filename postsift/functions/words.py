"""Clean text -> tokens -> kept words (F1-F35, M1, J6) of plain texts, on Arrow batches.

A text is plain if it has code points of ``PLAIN`` only: Latin letters to U+017F and common
punctuation, on which Python's string operations, its ``re`` and the JVM's patterns agree whatever
their Unicode version.  It takes the steps of ``text.CLEAN_STEPS`` that can change it, as ``text.py_steps`` does;
tokens are cut and looked up for many texts at once.  Any other text goes through ``base_forms(tokenize(clean_text))``,
whose result this is.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import CLEAN_STEPS, _to_python_re, clean_text
from .tokens import DEFAULT_LEXICON, KEEP_POS, NO_BASE, base_forms, tokenize

# U+0130 is the one whose lower case is two code points
PLAIN = "\x00-įı-ſ–—‘’“”…€"
TEXT_CHARS = 1 << 20        # characters of texts that are cut together, or one text's
CODES = 0x3100              # cleaning and NFKC make no larger code points of plain ones

_NOT_PLAIN = re.compile(f"[^{PLAIN}]")
# what a text must have for a step of this place in CLEAN_STEPS to change it
_NEEDS = {0: "<", 1: "pic.twitter.com/", 2: "instagram.com/", 3: "://", 4: "@", 5: "&", 11: "."}
_RE = {i: re.compile(_to_python_re(s[1])) for i, s in enumerate(CLEAN_STEPS) if s[0] == "regex"}


def _clean(t: str) -> str:
    for i, step in enumerate(CLEAN_STEPS):
        kind = step[0]
        if kind == "regex":
            if i not in _NEEDS or _NEEDS[i] in t:
                t = _RE[i].sub(step[2], t)
        elif kind == "literal":
            t = t.replace(step[1], step[2])
        elif kind == "chars":
            for k, c in enumerate(step[1]):
                if c in t:
                    t = t.replace(c, step[2][k:k + 1])
        elif kind == "lower":
            t = t.lower()
        elif kind == "strip":
            t = t.strip()
        elif not t.isascii():
            t = unicodedata.normalize("NFKC", t)
    return t


def _kinds() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter or number, 2 any other."""
    return np.array([0 if chr(c).isspace() else 1 if unicodedata.category(chr(c))[0] in "LN" else 2 for c in range(CODES)], np.int8)


def _words(texts: list, kinds: np.ndarray, known: pa.Array, words: pa.Array) -> pa.Array:
    """The kept words of plain texts, and null for the others."""
    plain = [t is not None and (t.isascii() or not _NOT_PLAIN.search(t)) for t in texts]
    clean = [_clean(t) if p else "" for t, p in zip(texts, plain)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in clean], dtype=np.int64)])
    flat = "".join(clean)
    codes = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    kind, n = kinds[codes], len(codes)
    begins = np.ones(n + 1, bool)
    begins[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    begins[bounds] = True
    starts = np.flatnonzero(begins[:n])
    at_byte = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF), dtype=np.int64)])
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at_byte[np.append(starts, n)].astype(np.int32)), pa.py_buffer(flat.encode()))
    visible = kind[starts] > 0
    tokens, starts = tokens.filter(pa.array(visible)), starts[visible]
    place = pc.index_in(tokens, value_set=known)
    tokens = pc.if_else(place.is_valid(), words.take(place), tokens)
    kept = tokens.is_valid()
    rows = np.searchsorted(bounds, starts[kept.to_numpy(zero_copy_only=False)], "right") - 1
    upto = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))])
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), tokens.filter(kept), mask=pa.array(~np.array(plain, bool)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def plain_words(s: pa.Array) -> pa.Array:
    known = pa.array(list(DEFAULT_LEXICON), pa.string())
    words = pa.array([None if pos not in KEEP_POS else k if base == NO_BASE else base for k, (pos, base) in DEFAULT_LEXICON.items()], pa.string())
    out, kinds, first, size = [], _kinds(), 0, 0
    for i, n in enumerate([*pc.fill_null(pc.utf8_length(s), 0).to_pylist(), TEXT_CHARS + 1]):
        if i > first and size + n > TEXT_CHARS:
            out.append(_words(s.slice(first, i - first).to_pylist(), kinds, known, words))
            first, size = i, 0
        size += n
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


def kept_words(c) -> Column:
    """``base_forms(tokenize(clean_text(c)))``, by Arrow batches where texts are plain."""
    c = F.col(c) if isinstance(c, str) else c
    plain = plain_words(c)
    return F.coalesce(plain, base_forms(tokenize(clean_text(F.when(plain.isNull(), c)))))
