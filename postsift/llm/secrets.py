"""Secrets in texts (operator 9).

Base kinds are found by pattern: assign (a named value), access (key ids), hex (long hex
strings).  The method adds kind ``entropy``: a window slides over each candidate string,
the counts of its characters are updated by one in and one out, and with them the Shannon
entropy of the window, for each character class the string has (hex digits; base 64).
Windows over the class's threshold are joined to spans.  An allow-list takes out what is
random-looking but known: UUIDs, words in a row, sample keys, numbers, checksums by name.

All searches are linear in the text.  Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import re
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import apart, digest, joined, ordered
from .memory import handing_back

# The kinds, as listed.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")

WINDOW = 20
# Bits per character from which a window of a class counts, and what it must hold.
THRESHOLDS = {"hex": 3.0, "base64": 3.9}

# Strings that are no secrets although they look random.
ALLOWED = (
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",     # UUID
    r"[A-Z]?[a-z]+(?:[-_/+=]+[A-Z]?[a-z]+)*[-_/+=]*",             # words in a row
    r"(?:[A-Z]?+[a-z]{2,}+)++[0-9]{0,3}+",                        # CamelCase names (of 17 letters and more, so three parts)
    r"[-_=+/0-9]+",                                               # numbers and rules
)
# Words of samples; the token that holds one is allowed, not its neighbours.
SAMPLES = r"EXAMPLE|example|XXXX|xxxx|placeholder|your[-_]"
ALLOWED_BEFORE = r"(?:sha(?:1|256|384|512)?|md5|crc32|commit|checksum|digest|integrity|uuid)[-\x20\"']*[:=-]?[\x20\"']*$"

_assign = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_names = ("password", "passwd", "secret", "token", "apikey", "api_key")
_access = re.compile(r"AKIA[A-Z0-9]+")
_candidate = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_hex = re.compile(r"[0-9a-f]{32,}")
_hex_run = re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}")
_allowed = re.compile("|".join(f"(?:{p})" for p in ALLOWED), re.DOTALL)
_samples = re.compile(SAMPLES)
_token = re.compile(r"[^/=]{20,}")
_allowed_before = re.compile(ALLOWED_BEFORE, re.IGNORECASE | re.ASCII)
_xlogx = [0.0] + [i * log2(i) for i in range(1, WINDOW + 1)]


def hot_stretches(s: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Unions of the windows of ``s`` whose entropy reaches ``threshold``.  With counts c,
    the entropy is log2(window) - sum(c log2 c) / window; one step changes two counts."""
    counts: dict[str, int] = {}
    total, out = 0.0, []
    top = window * (log2(window) - threshold) + 1e-9
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _xlogx[n + 1] - _xlogx[n]
        if i >= window:
            d = s[i - window]
            n = counts[d]
            counts[d] = n - 1
            total += _xlogx[n - 1] - _xlogx[n]
        if i >= window - 1 and total <= top:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def _mixed(s: str, kind: str) -> bool:
    digits = any(c.isdigit() for c in s)
    if kind == "hex":
        return digits and any(c.isalpha() for c in s)
    return digits and any(c.islower() for c in s) and any(c.isupper() for c in s)


def _entropy(s: str) -> list[tuple[int, int]]:
    """Spans in one candidate string."""
    found, at = [], 0
    for m in _hex_run.finditer(s):
        found += [(m.start() + a, m.start() + b) for a, b in hot_stretches(m.group(), THRESHOLDS["hex"]) if _mixed(m.group()[a:b], "hex")]
    for a, b in hot_stretches(s, THRESHOLDS["base64"]):
        if _mixed(s[a:b], "base64"):
            found.append((a, b))
    out = []
    for a, b in sorted(found):
        if out and a < at:
            out[-1] = (out[-1][0], max(at, b))
        else:
            out.append((a, b))
        at = out[-1][1]
    return out


def _judged(s: str) -> list[tuple[int, int]]:
    """Entropy spans in a candidate.  One with the word of a sample is judged token by token
    (its parts between / and =): the tokens with such a word are allowed, not their neighbours."""
    if not _samples.search(s):
        return [] if _allowed.fullmatch(s) else _entropy(s)
    tokens = [m for m in _token.finditer(s) if not _samples.search(m[0]) and not _allowed.fullmatch(m[0])]
    return [(m.start() + a, m.start() + b) for m in tokens for a, b in _entropy(m[0])]


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans in order.  Base spans always stay; an entropy span
    that overlaps one is left out."""
    if not text:
        return []
    base, added = [], []
    low = text.lower()
    if any(n in low for n in _names):
        base += [("assign", *m.span()) for m in _assign.finditer(text) if len(m.group(1)) >= 8]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in _access.finditer(text) if m.end() - m.start() >= 16]
    for m in _candidate.finditer(text):
        s, at = m.group(), m.start()
        base += [("hex", at + h.start(), at + h.end()) for h in _hex.finditer(s)]
        if not _allowed_before.search(text[max(0, at - 24):at]):
            added += [("entropy", at + a, at + b) for a, b in _judged(s)]
    return ordered(base + apart(added, base), KINDS)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, spans: array of (kind, start, end).  Null and empty texts have none; one row
    per input row, repeated rows and null ids included; other columns are ignored."""
    @handing_back
    def run(batches):
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t.as_py())] for t in b.column(1)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, counts of the base kinds, base_sha256 and spans (kind:start:end, joined)."""
    @handing_back
    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                found = find(t.as_py())
                base = [s for s in found if s[0] in BASE]
                kinds = [s[0] for s in base]
                rows.append((*[kinds.count(k) for k in BASE], digest(base), joined(found)))
            cols = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
