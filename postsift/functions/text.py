"""Post text cleaning (F1-F36, F42) as Spark column expressions.

The chain is declared once as data (``CLEAN_STEPS``) and compiled to one nested Spark
expression (so whole-stage codegen sees a single projection) and, for the oracle, to the
equivalent DuckDB SQL expression.  Regex steps use the dialect that Java (Spark) and RE2
(DuckDB) share; Python's Unicode ``\\w`` is spelled ``[\\p{L}\\p{N}_]`` and ``\\d`` is
``\\p{Nd}``, which agree with Python on every assigned code point the JVM knows.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results), natural order.
# URL character class of the link steps and handle class of the mention/entity steps.
URL_CHARS = r"[-_.!~*'()a-zA-Z0-9;/?:@&=+$,%#]+"
HANDLE_CHARS = r"[\p{L}\p{N}_/:%#$&?()~.=+\-…]+"
# White space removed by the final strip (Python str.isspace), as a regex class body.
STRIP_CLASS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The cleaning chain, in order.  Step kinds:
#   regex   (pattern, replacement)   every non-overlapping match, left to right
#   literal (text, replacement)      plain substring replacement
#   chars   (from, to)               per-character map; characters of `from` beyond the
#                                    length of `to` are deleted
#   lower / strip / nfkc
# Consecutive single-character deletions/maps with no multi-character step between them
# are one `chars` step (their relative order cannot change the result).
CLEAN_STEPS = [
    ("regex", r"<[^<]+?>", ""),                                  # F1 tags
    ("regex", r"pic\.twitter\.com/" + URL_CHARS, ""),            # F2
    ("regex", r"instagram\.com/" + URL_CHARS, ""),               # F3
    ("regex", r"(https?|ftp)(://" + URL_CHARS + ")", ""),        # F4
    ("regex", "@" + HANDLE_CHARS, ""),                           # F5 mentions
    ("regex", "&" + HANDLE_CHARS, ""),                           # F6 entity-like runs
    ("literal", ";", ""),                                        # F7
    ("literal", "RT", ""),                                       # F8
    ("chars", "#?？！!()（）\n", ""),                              # F9-F18
    ("regex", r"\p{Nd}+", "0"),                                  # F19 digit runs
    ("chars", "、・", ","),                                        # F20-F21
    ("regex", r"\.(?s:..)", ""),                                 # F22 a dot plus two characters
    ("chars", "，．.[]「」【】/", ",。。"),                            # F23-F32
    ("lower",),                                                  # F33
    ("strip",),                                                  # F34
    ("nfkc",),                                                   # F35
]
# Subset applied to scraped text (F36): tags, links, mentions, entities, ';', 'RT', newline.
SCRAPE_STEPS = CLEAN_STEPS[:8] + [("literal", "\n", "")]
# ---------------------------------------------------------------------------

NFKC_ROWS = 256     # texts that are Python strings together

STRIP_PATTERN = r"\A[" + STRIP_CLASS + r"]+|[" + STRIP_CLASS + r"]+\z"


def _nfkc(s: pa.Array) -> pa.Array:
    """NFKC of each string; an array of normal ones is given back as it is, and others are made a slice at a time."""
    out, changed = [], False
    for at in range(0, len(s), NFKC_ROWS):
        some = s.slice(at, NFKC_ROWS)
        texts = [t.as_py() for t in some if t.is_valid] if not pc.all(pc.string_is_ascii(some)).as_py() else []
        if all(unicodedata.is_normalized("NFKC", t) for t in texts):
            out.append(some)
        else:
            changed = True
            out.append(pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in some.to_pylist()], s.type))
    return pa.concat_arrays(out) if changed else s


@F.arrow_udf(T.StringType())
def nfkc(s: pa.Array) -> pa.Array:
    """NFKC normalisation (F35), Arrow-batched; already-normal strings pass through."""
    return _nfkc(s)


@F.arrow_udf(T.StringType())
def ascii_lower(s: pa.Array) -> pa.Array:
    """The letters A-Z as a-z, and nothing else; Arrow-batched (``translate`` takes a string for each character)."""
    return pc.ascii_lower(s)


def normalized(c: Column) -> Column:
    """NFKC of ``c``.  The guard is inside the function: a condition around it would repeat the
    whole expression of ``c`` in the plan."""
    return nfkc(c)


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` semantics (Spark's trim only strips U+0020)."""
    return F.regexp_replace(c, STRIP_PATTERN, "")


def _apply(c: Column, step) -> Column:
    kind = step[0]
    if kind == "regex":
        return F.regexp_replace(c, step[1], step[2])
    if kind == "literal":
        return F.replace(c, F.lit(step[1]), F.lit(step[2]))
    if kind == "chars":
        return F.translate(c, step[1], step[2])
    if kind == "lower":
        return F.lower(c)
    if kind == "strip":
        return strip_ws(c)
    if kind == "nfkc":
        return normalized(c)
    raise ValueError(kind)


def apply_steps(c: Column, steps, normalize: bool = True) -> Column:
    for st in steps:
        if st[0] == "nfkc" and not normalize:
            continue
        c = _apply(c, st)
    return c


def clean_text(c, normalize: bool = True) -> Column:
    """The full cleaning chain F1-F35 (``normalize=False`` stops after F34)."""
    c = F.col(c) if isinstance(c, str) else c
    return apply_steps(c, CLEAN_STEPS, normalize)


def scrape_clean(c) -> Column:
    """the subset applied to scraped page text."""
    c = F.col(c) if isinstance(c, str) else c
    return apply_steps(c, SCRAPE_STEPS)


def strip_tags(c) -> Column:
    """F1/F41 alone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, CLEAN_STEPS[0][1], "")


def tidy_text(c) -> Column:
    """strip white space, then drop carriage returns; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(strip_ws(c), F.lit("\r"), F.lit(""))


# ---------------------------------------------------------------- DuckDB twin
def sql_str(s: str) -> str:
    """A DuckDB string literal; control characters go through chr()."""
    parts, buf = [], ""
    for ch in s:
        if ord(ch) < 32:
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def sql_steps(expr: str, steps, normalize: bool = False) -> str:
    """The same chain as a DuckDB expression (RE2 with the `g` / `gs` flags).

    DuckDB has no NFKC; the oracle omits it (identity on the given tables)."""
    for st in steps:
        kind = st[0]
        if kind == "regex":
            expr = f"regexp_replace({expr}, {sql_str(st[1])}, {sql_str(st[2])}, 'g')"
        elif kind == "literal":
            expr = f"replace({expr}, {sql_str(st[1])}, {sql_str(st[2])})"
        elif kind == "chars":
            expr = f"translate({expr}, {sql_str(st[1])}, {sql_str(st[2])})"
        elif kind == "lower":
            expr = f"lower({expr})"
        elif kind == "strip":
            expr = f"regexp_replace({expr}, {sql_str(STRIP_PATTERN)}, '', 'g')"
        elif kind == "nfkc" and normalize:
            raise ValueError("DuckDB has no NFKC")
    return expr


def sql_clean(expr: str) -> str:
    return sql_steps(expr, CLEAN_STEPS)


def sql_scrape(expr: str) -> str:
    return sql_steps(expr, SCRAPE_STEPS)


def sql_tidy(expr: str) -> str:
    return f"replace(regexp_replace({expr}, {sql_str(STRIP_PATTERN)}, '', 'g'), chr(13), '')"


# ------------------------------------------------------ pure-Python twin (tests)
def _to_python_re(pat: str) -> str:
    """Map the shared dialect back to Python `re`: \\w / \\d classes, \\x{..}, \\z."""
    import re
    pat = pat.replace(r"\p{L}\p{N}_", r"\w").replace(r"\p{Nd}", r"\d").replace(r"\z", r"\Z")
    return re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: "\\u%04x" % int(m.group(1), 16), pat)


def py_steps(text: str, steps, normalize: bool = True) -> str:
    """Run a step list with Python's own `re` semantics (the reference's engine)."""
    import re
    t = text
    for st in steps:
        kind = st[0]
        if kind == "regex":
            t = re.sub(_to_python_re(st[1]), st[2], t)
        elif kind == "literal":
            t = t.replace(st[1], st[2])
        elif kind == "chars":
            frm, to = st[1], st[2]
            t = t.translate({ord(a): (to[i] if i < len(to) else None) for i, a in enumerate(frm)})
        elif kind == "lower":
            t = t.lower()
        elif kind == "strip":
            t = t.strip()
        elif kind == "nfkc" and normalize:
            t = unicodedata.normalize("NFKC", t)
    return t


def py_clean(text: str, normalize: bool = True) -> str:
    return py_steps(text, CLEAN_STEPS, normalize)
