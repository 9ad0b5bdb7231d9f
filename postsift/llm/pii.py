"""Personal data in texts (operator 1).

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for
IBANs, a weighted sum for US routing numbers) and words near a span adjust its score.

Base kinds are kept whatever their score: email, ip, card, phone.  The method adds kinds
that need more than their form: iban (mod 97), ssn, routing and date_of_birth; these are
kept from ``THRESHOLD`` on.  All patterns take time linear in the text.

Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import re
from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import apart, digest, joined, ordered
from .memory import handing_back

# The kinds, as listed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "routing", "date_of_birth")
KINDS = BASE + ADDED

# Score of a kind by form and checksum alone, and words that raise it when
# they stand near (lower case, ASCII).
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "routing": 0.2, "date_of_birth": 0.2}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "bic", "swift", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "tax id", "taxpayer"),
    "routing": ("routing", "aba", "bank", "transfer"),
    "date_of_birth": ("born", "birth", "dob", "geboren", "née", "nacido"),
}
AGAINST = {"ip": ("version", "release", "section"), "card": ("order", "isbn", "tracking"), "phone": ("isbn", "order")}
RAISE, LOWER = 0.35, 0.3
THRESHOLD = 0.5
WINDOW = 48          # code points on each side in which context words count

# Proposals.  Every run that a pattern starts with is taken whole (possessive), which
# changes no match and keeps the search linear.
_local = re.compile(r"[A-Za-z0-9._%+-]")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"[0-9]++((?:\.[0-9]++){3})?+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ssn = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_routing = re.compile(r"(?<![0-9])[0-9]{9}(?![0-9])")
_date = re.compile(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])")
_not_digit = re.compile(r"[^0-9]+")
_digit = re.compile(r"[0-9]").search
_three = re.compile(r"[0-9]{3}").search

_DOUBLED = [sum(divmod(2 * d, 10)) for d in range(10)]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += _DOUBLED[d] if i % 2 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def routing_sum(d: str) -> bool:
    return sum(int(c) * w for c, w in zip(d, (3, 7, 1) * 3)) % 10 == 0 and d != "0" * 9


def _emails(text: str):
    at, after = text.find("@"), 0
    while at >= 0:
        start = at
        while start > after and _local.match(text[start - 1]):
            start -= 1
        hit = _domain.match(text, at + 1) if start < at else None
        if hit:
            yield start, hit.end()
            after = hit.end()
            at = text.find("@", after)
        else:
            after = at + 1
            at = text.find("@", at + 1)


def _ips(text: str):
    for m in _ip.finditer(text):
        if m.group(1) and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def _ibans(text: str):
    at = 0
    while m := _iban.search(text, at):
        hit = m.group()
        # following words in capitals may have been taken in: also try the shorter forms
        while not mod97(hit) and " " in hit:
            hit = hit[:hit.rindex(" ")]
        if mod97(hit):
            at = m.start() + len(hit)
            yield m.start(), at
        else:
            at = m.start() + 1          # the pattern starts with words only


def _proposals(text: str):
    """(kind, start, end) of what passes form and checksum."""
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    if not _digit(text):
        return
    if "." in text:
        for s, e in _ips(text):
            yield "ip", s, e
    for m in _card.finditer(text):
        if m.end() - m.start() >= 12:
            d = _not_digit.sub("", m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                yield "card", *m.span()
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= len(_not_digit.sub("", m.group())) <= 15:
                yield "phone", *m.span()
    for s, e in _ibans(text):
        yield "iban", s, e
    if not _three(text):
        return
    for m in _ssn.finditer(text):
        a, b, c = m.group().split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            yield "ssn", *m.span()
    for m in _routing.finditer(text):
        if routing_sum(m.group()):
            yield "routing", *m.span()
    for m in _date.finditer(text):
        p = re.split(r"[./-]", m.group())
        year, month, day = (p if len(p[0]) == 4 else (p[2], p[1], p[0]))
        if 1900 <= int(year) <= 2030 and 1 <= int(month) <= 12 and 1 <= int(day) <= 31:
            yield "date_of_birth", *m.span()


_words = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, w)) + ")") for k, w in CONTEXT.items()}
_words_against = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, w)) + ")") for k, w in AGAINST.items()}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - WINDOW):start] + "\n" + text[end:end + WINDOW]).lower()
    s = PRIOR[kind]
    if _words[kind].search(near):
        s += RAISE
    if kind in _words_against and _words_against[kind].search(near):
        s -= LOWER
    return round(min(1.0, max(0.0, s)), 4)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans that are kept, in order.  An added span that
    overlaps a base span is left out; overlaps between kinds of one sort stay."""
    if not text:
        return []
    base, added = [], []
    for kind, start, end in _proposals(text):
        s = score(text, kind, start, end)
        if kind in BASE:
            base.append((kind, start, end, s))
        elif s >= THRESHOLD:
            added.append((kind, start, end, s))
    return ordered(base + apart(added, base), KINDS)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by <KIND>; of overlapping spans the one that
    starts first (the longer one on ties) names the whole stretch."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    stretch = None
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if stretch and start < stretch[2]:
            stretch = (stretch[0], stretch[1], max(end, stretch[2]))
            continue
        if stretch:
            out += [text[at:stretch[1]], f"<{stretch[0].upper()}>"]
            at = stretch[2]
        stretch = (kind, start, end)
    out += [text[at:stretch[1]], f"<{stretch[0].upper()}>", text[stretch[2]:]]
    return "".join(out)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, spans: array of (kind, start, end, score).  Null and empty texts have none;
    one row per input row, repeated rows and null ids included; other columns are ignored."""
    @handing_back
    def run(batches):
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in find(t.as_py())] for t in b.column(1)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>")
    return out.withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced; null stays null, all other
    columns and the number of rows stay."""
    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        @handing_back
        def run(batches):
            for texts in batches:
                yield texts.map(redact, na_action="ignore")

        yield from run(batches)

    return docs.withColumn(text_col, clean(F.col(text_col)))


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
            cols = [pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
