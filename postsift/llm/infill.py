"""Fill-in-middle transformation by repeated-capture matching (operator 13).

A text is cut into units by one full match of ``(unit)*``: the ``regex`` library keeps every
repetition of a group, so the number of units and the offset after each of them are those of
the one match (``match.ends(1)``); both cuts are read off that list.  The draws (cuts, form)
come from a hash of the seed and the row's id, so that reruns agree and rows need nothing of
each other: no shuffle.

Markers around the parts make the output reversible: a text that holds a marker stays plain,
and a marker cannot arise where parts meet (each begins with its only ``<``).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import utf8
from .memory import handing_back

CODE_POINT, GRAPHEME, WORD = r"(?s:.)", r"\X", r"\s*\S+\s*|\s+"     # units
PLAIN, PSM, SPM = "plain", "psm", "spm"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Infill:
    """Parameters of the transformation: the unit's pattern (it must match at every place of a
    text and not the empty string), the seed of the draws, the share of texts in 100 that are
    cut, and the share in 100 of those whose suffix comes first."""
    unit: str = CODE_POINT
    seed: str = "1"
    cut_share: int = 90
    spm_share: int = 20


@dataclass(frozen=True)
class Parts:
    """A transformed text: units in it, its form, the parts' lengths in units (none if plain)
    and the output."""
    n: int
    form: str
    prefix: int | None
    middle: int | None
    output: str


def draws(seed: str, key) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a row: the first 32 hex digits of the digest of the
    seed and the id (a null id is the empty word)."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def matcher(unit: str):
    """The full match of repeated units, without giving back any of them."""
    return regex.compile(f"({unit})*+")


def transform(text: str | None, key, how: Infill, units=None) -> Parts:
    """The fill-in-middle form of a text; a null text is the empty one."""
    text = text or ""
    found = (units or matcher(how.unit)).fullmatch(text)
    if found is None:
        raise ValueError("the unit does not match at every place of a text")
    ends = found.ends(1)
    n = len(ends)
    first, second, cut, order = draws(how.seed, key)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or cut % 100 >= how.cut_share:
        return Parts(n, PLAIN, None, None, text)
    a, b = sorted((first % (n + 1), second % (n + 1)))
    i, j = (ends[a - 1] if a else 0), (ends[b - 1] if b else 0)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if order % 100 < how.spm_share:
        return Parts(n, SPM, a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
    return Parts(n, PSM, a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))


def restore(output: str, form: str) -> str:
    """The text that ``transform`` was given, from its output and form alone."""
    if form == PLAIN:
        return output
    head, middle = output.split(MIDDLE)
    one, other = (SUFFIX, PREFIX) if form == SPM else (PREFIX, SUFFIX)
    front, back = head.removeprefix(one).split(other)
    return back + middle + front if form == SPM else front + middle + back


_FIELDS = [("n", pa.int64()), ("form", pa.string()), ("prefix", pa.int64()), ("middle", pa.int64())]


def _mapped(docs: DataFrame, id_col: str, text_col: str, how: Infill, extra: list, of) -> DataFrame:
    """One row per row: its id, the parts' figures and what ``of`` makes of its ``Parts``."""
    @handing_back
    def run(batches):
        units = matcher(how.unit)
        for b in batches:
            ids = [i.as_py() for i in b.column(0)]
            rows = []
            for key, text in zip(ids, b.column(1)):
                p = transform(text.as_py(), key, how, units)
                rows.append((p.n, p.form, p.prefix, p.middle, *of(p)))
            cols = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", *[f for f, _ in fields]])

    fields = _FIELDS + [(c, pa.string()) for c in extra]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} {'long' if t == pa.int64() else 'string'}" for c, t in fields)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def infill(docs: DataFrame, how: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n (units), form, prefix and middle (units; null if plain) and output of every
    row.

    * null or empty text: n 0, plain, empty output; null ids draw as the empty word.
    * repeated rows: one result each, all the same; equal ids draw the same numbers.
    * very long texts: one match each; about 60 bytes of memory a unit while it is at work.
    * other columns are ignored and may have any name; an empty table gives an empty result.
    """
    return _mapped(docs, id_col, text_col, how, ["output"], lambda p: (p.output,))


def digests(docs: DataFrame, how: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars, and SHA-256 digests of the output and of the
    text that is restored from it."""
    def of(p):
        return [hashlib.sha256(utf8(t)).hexdigest() for t in (p.output, restore(p.output, p.form))]

    out = _mapped(docs, id_col, text_col, how, ["output_sha256", "restored_sha256"], of)
    return out.withColumnsRenamed({"prefix": "prefix_chars", "middle": "middle_chars"})
