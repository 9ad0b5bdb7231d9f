"""Offset-preserving SentencePiece encoding and decoding (operator 6).

Works from the model file alone (BPE models with byte fallback):

* normalisation: at each position the longest key of the compiled character map (a
  double-array trie over UTF-8 bytes) is replaced by its value, otherwise one character is
  kept; white space is escaped, and a dummy prefix and the removal of extra spaces follow
  the model's settings.  Every normalised character records the source byte it came from.
* segmentation: the best-scored adjacent pair of symbols is merged first, the leftmost on
  ties.  No piece holds a space mark after another character, so a text falls into words
  that are segmented on their own: the new words of some texts together, one merge of each
  at a time, on arrays.  A word's segmentation is remembered in a bounded table.
* every piece is projected to its span of source bytes; of the bytes of a character that
  is not in the vocabulary the last one holds the span, the others are empty.

The model (its bytes, a few hundred KB) travels to the tasks with the function.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import handing_back

MARK = "▁"                   # the escaped space in pieces; inside this module it is a space
REMEMBERED_WORDS = 60_000    # of each of the two generations of a worker's table
TOGETHER = 1 << 20           # characters of text whose words are segmented together
LONG_WORD = 64               # characters; longer words are merged one by one, by a heap
MAX_MODEL_BYTES = 64 << 20   # a model over this is refused, as it travels with each task
_NO_RANK = 1 << 30
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes):
    """(number, value) of the fields of one protocol-buffer message."""
    at, n = 0, len(b)

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            x = b[at]
            at += 1
            value |= (x & 127) << shift
            if x < 128:
                return value
            shift += 7

    while at < n:
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 1:
            yield key >> 3, b[at:at + 8]
            at += 8
        elif key & 7 == 5:
            yield key >> 3, b[at:at + 4]
            at += 4
        else:
            size = varint()
            yield key >> 3, b[at:at + size]
            at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled character map (may be empty)."""

    def __init__(self, blob: bytes):
        self.units, self.values = (), b""
        if blob:
            size = struct.unpack("<I", blob[:4])[0]
            self.units = struct.unpack(f"<{size // 4}I", blob[4:4 + size])
            self.values = blob[4 + size:]

    def longest(self, b: bytes, at: int) -> tuple[int, str] | None:
        """Length in bytes of the longest key at ``at``, and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = _jump(units[0])
        for i in range(at, len(b)):
            node ^= b[i]
            unit = units[node]
            if unit & 0x800000FF != b[i]:
                break
            node ^= _jump(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.values.index(b"\0", found[1])
        return found[0], self.values[found[1]:end].decode("utf-8")


def _windows(norm: str):
    """A normalised text in pieces of about ``TOGETHER`` characters, cut before a space that
    begins a word."""
    at, n = 0, len(norm)
    while n - at > TOGETHER:
        end = at + TOGETHER
        while 0 < (end := norm.find(" ", end)) and norm[end - 1] == " ":
            end += 1
        if end < 0:
            break
        yield norm[at:end]
        at = end
    yield norm[at:]


def _jump(unit: int) -> int:
    return (unit >> 10) << ((unit & 512) >> 6)


class Codec:
    def __init__(self, model: bytes):
        pieces, self.unk_surface = [], " ⁇ "
        kind, fallback, charmap = 1, False, b""
        self.dummy_prefix, self.trim, self.escape = True, True, True
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode("utf-8"), struct.unpack("<f", own.get(2, b"\0" * 4))[0], own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                kind, fallback = own.get(3, 1), bool(own.get(35, 0))
                if 44 in own:
                    self.unk_surface = own[44].decode("utf-8")
                if own.get(24, 0):
                    raise ValueError("models with the space mark as suffix are not supported")
            elif number == 3:
                own = dict(_fields(value))
                charmap = own.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        if any(len(p) > 255 for p, _, _ in pieces):
            raise ValueError("pieces of over 255 characters are not supported")
        if not self.escape:
            raise ValueError("models that do not escape white space are not supported")
        if kind != 2 or not fallback or any(k in (USER_DEFINED, UNUSED) for _, _, k in pieces):
            raise ValueError("a BPE model with byte fallback and without user-defined or unused pieces is needed")
        self.map = CharacterMap(charmap)
        self.pieces = [p.replace(MARK, " ") for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        scores = [s for _, s, _ in pieces]
        order = {x: r for r, x in enumerate(sorted({-scores[i] for i in self.ids.values()}))}
        self.rank = {p: order[-scores[i]] for p, i in self.ids.items()}
        self.byte_ids = [0] * 256
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
        long = [p for p in self.ids if len(p) > 1]
        if any(" " in p.lstrip(" ") for p in long):
            raise ValueError("pieces with a space mark inside are not supported")
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in long))
        cls = re.escape(alone)
        self.words = re.compile((f"[{cls}]|" if alone else "") + f" *[^ {cls}]+| +").findall
        self.numerals = [str(i) for i in range(len(pieces))]
        self.young: dict = {}
        self.old: dict = {}
        self._tables()

    def _tables(self) -> None:
        """Arrays for merging: the id of each character (-1: not in the vocabulary), and for
        each pair of ids whose pieces join to a piece, the rank and id of that."""
        n = len(self.pieces)
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        pairs = [(self.ids[p[:k]] * n + self.ids[p[k:]], self.rank[p], i)
                 for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        pairs.sort()
        self.pair_keys = np.array([x[0] for x in pairs] + [1 << 62], np.int64)
        self.pair_ranks = np.array([x[1] for x in pairs] + [_NO_RANK], np.int64)
        self.pair_ids = np.array([x[2] for x in pairs] + [0], np.int64)
        self.lengths = np.array([min(255, len(p)) for p in self.pieces], np.uint8)

    # ---- normalisation
    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters (and the end) the source
        byte up to which the text before it is used up."""
        if not self.map.units and not self.trim:
            if not text:
                return "", np.zeros(1, np.int64)
            out, ends = self._inside(text), _byte_starts(text)
            if self.dummy_prefix:
                out, ends = " " + out, np.concatenate([ends[:1], ends])
            return out, ends
        return self._by_map(text.encode("utf-8"))

    def _by_map(self, b: bytes) -> tuple[str, np.ndarray]:
        at, n = 0, len(b)
        space = " "

        def step(at):
            hit = self.map.longest(b, at)
            if hit:
                return hit
            width = 1 if b[at] < 0x80 else 2 if b[at] < 0xE0 else 3 if b[at] < 0xF0 else 4
            return width, b[at:at + width].decode("utf-8")

        if self.trim:
            while at < n:
                width, out = step(at)
                if out != " ":
                    break
                at += width
        if at == n:
            return "", np.array([at])
        chars, starts = [], []
        if self.dummy_prefix:
            chars.append(space)
            starts.append(at)
        after_space = self.trim
        while at < n:
            width, out = step(at)
            if after_space:
                out = out.lstrip(" ")
            if out:
                chars.extend(space if c == " " else c for c in out)
                starts.extend([at] * len(out))
                after_space = self.trim and out.endswith(" ")
            at += width
        end = at
        if self.trim:
            while chars and chars[-1] in (space, MARK):
                chars.pop()
                end = starts.pop()
        starts.append(end)
        return self._inside("".join(chars)), np.array(starts, np.int64)

    def _inside(self, text: str) -> str:
        """Space marks of the text are spaces here, like the spaces that are escaped."""
        return text.replace(MARK, " ") if MARK in text else text

    # ---- segmentation
    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what pairs of ids join to (no rank: nothing)."""
        key = left * len(self.pieces) + right
        at = np.searchsorted(self.pair_keys, key)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], _NO_RANK), self.pair_ids[at]

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids of all words in a row, and the number of pieces of each word.  All
        characters must be in the vocabulary.  Each round merges in every word the best pair
        (the leftmost on ties), until no word has one."""
        count = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.char_ids[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].astype(np.int64)
        done_ids, done_word = [], []
        word = np.repeat(np.arange(len(words)), count)
        rank, joined = self._look_up(sym, np.append(sym[1:], 0))
        rank[np.cumsum(count) - 1] = _NO_RANK
        while len(sym):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            over = np.repeat(best == _NO_RANK, size)
            if over.any():
                done_ids.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, rank, joined = sym[keep], word[keep], rank[keep], joined[keep]
                open_ = best != _NO_RANK
                best, size = best[open_], size[open_]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[np.diff(word[at], prepend=-1) != 0]         # the leftmost of each word
            sym[at] = joined[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))                         # places after the others went
            sym, word, rank, joined = sym[keep], word[keep], rank[keep], joined[keep]
            last = np.append(word[1:] != word[:-1], True)
            rank[at], joined[at] = self._look_up(sym[at], np.append(sym, 0)[at + 1])
            rank[last] = _NO_RANK
            left = at - 1
            left = left[(left >= 0) & (word[left] == word[at])]
            rank[left], joined[left] = self._look_up(sym[left], sym[left + 1])
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))

    def merge(self, word: str) -> list[str]:
        """Pieces of one word of any characters."""
        return self._merge_long(list(word))

    def _merge_long(self, s: list[str]) -> list[str]:
        """The same by a heap over a linked list, for words of any length."""
        n, rank = len(s), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i] + s[i + 1]) for i in range(n - 1) if (r := rank(s[i] + s[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if s[i] is None or j >= n or s[i] + s[j] != both:
                continue
            s[i], s[j] = both, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := rank(s[a] + s[after[a]])) is not None:
                    heapq.heappush(heap, (r, a, s[a] + s[after[a]]))
        return [x for x in s if x is not None]

    def word(self, word: str) -> tuple[tuple, tuple]:
        """Ids of a word's pieces, and the normalised characters that each uses up."""
        pieces = self.merge(word)
        try:
            return tuple([self.ids[p] for p in pieces]), tuple(map(len, pieces))
        except KeyError:
            pass
        ids, used = [], []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                ids.append(i)
                used.append(len(p))
            else:
                raw = p.encode("utf-8")
                ids.extend(self.byte_ids[x] for x in raw)
                used.extend([0] * (len(raw) - 1) + [1])
        return tuple(ids), tuple(used)

    def learn(self, words: list[str]) -> None:
        """Remembers, for each of the words, (ids as text, characters used by each piece,
        decoded text)."""
        known = self.char_ids
        plain, numerals, young = [], self.numerals, self.young
        size = np.fromiter(map(len, words), np.int64, len(words))
        in_vocabulary = np.logical_and.reduceat(known[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)] >= 0,
                                                np.concatenate([[0], np.cumsum(size)[:-1]]))
        for w, fine in zip(words, (in_vocabulary & (size <= LONG_WORD)).tolist()):
            if fine:
                plain.append(w)
            else:
                ids, used = self.word(w)
                young[w] = ",".join([numerals[i] for i in ids]), bytes(used), self.plain(ids)
        if plain:
            ids, count = self.merge_all(plain)
            used, texts = self.lengths[ids].tobytes(), [numerals[i] for i in ids.tolist()]
            at = 0
            for w, n in zip(plain, count.tolist()):
                young[w] = ",".join(texts[at:at + n]), used[at:at + n], w
                at += n

    def forget(self) -> None:
        """Drops the older generation of the remembered words."""
        self.old = {}

    def parts(self, texts: list[str]) -> list[tuple[str, bytes, str, np.ndarray]]:
        """For each text: its ids as text, the characters used by each piece, the decoded
        text with the dummy prefix, and the source bytes of the normalised text."""
        normal = [self.normalise(t) for t in texts]
        out = [([], [], [], ends) for _, ends in normal]
        todo = [(i, piece) for i, (norm, _) in enumerate(normal) for piece in _windows(norm)]
        at = 0
        while at < len(todo):
            size, some = 0, []
            while at < len(todo) and (not some or size + len(todo[at][1]) <= TOGETHER):
                size += len(todo[at][1])
                some.append((todo[at][0], self.words(todo[at][1])))
                at += 1
            if len(self.young) >= REMEMBERED_WORDS:
                self.old, self.young = self.young, {}
            need = set().union(*[w for _, w in some]).difference(self.young)
            for w in need & self.old.keys():
                self.young[w] = self.old[w]
            if need := [w for w in need if w not in self.young]:
                self.learn(need)
            for i, words in some:
                if words:
                    for mine, found in zip(out[i], zip(*map(self.young.__getitem__, words))):
                        mine.extend(found)
        return [(",".join(ids), b"".join(used), "".join(plain), ends) for ids, used, plain, ends in out]

    @staticmethod
    def spans(used: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source bytes of each piece: begins and ends."""
        n = np.frombuffer(used, np.uint8)
        last = np.cumsum(n, dtype=np.int64)
        return ends[last - n], ends[last]

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        return [([int(i) for i in ids.split(",")] if ids else [], *self.spans(used, ends)) for ids, used, _, ends in self.parts(texts)]

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        return self.encode_all([text])[0]

    # ---- decoding
    def plain(self, ids) -> str:
        """Text of pieces in a row, the space of a dummy prefix included."""
        out, raw = [], bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                raw.append(int(self.pieces[i][1:-1], 16))
                continue
            if raw:
                out.append(_lenient(bytes(raw)))
                raw.clear()
            if kind == UNKNOWN:
                out.append(self.unk_surface)
            elif kind != CONTROL:
                out.append(self.pieces[i])
        if raw:
            out.append(_lenient(bytes(raw)))
        return "".join(out)

    def strip_prefix(self, text: str, ids) -> str:
        """Without the space marks that the pieces at the start lose: one of the first
        piece, and while spaces are trimmed, of those after pieces that became empty."""
        drop = 0
        if self.dummy_prefix or self.trim:
            for i in ids:
                if self.kinds[i] == CONTROL:
                    continue
                if self.kinds[i] != NORMAL or not self.pieces[i].startswith(" "):
                    break
                drop += 1
                if not self.trim or len(self.pieces[i]) > 1:
                    break
        return text[drop:]

    def decode(self, ids: list[int]) -> str:
        return self.strip_prefix(self.plain(ids), ids)


def _lenient(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is not part of a character."""
    out, at = [], 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + width].decode("utf-8"))
                at += width
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _byte_starts(text: str) -> np.ndarray:
    """Byte offset of each character of ``text``, and of its end."""
    if text.isascii():
        return np.arange(len(text) + 1)
    b = np.frombuffer(text.encode("utf-8"), np.uint8)
    return np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))


@lru_cache(maxsize=2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def load_model(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"the model has more than {MAX_MODEL_BYTES} bytes")
    Codec(model)
    return model


def encode(docs: DataFrame, model: bytes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, ids, begins, ends (source bytes of each piece), decoded (the ids decoded).

    Null or empty text: empty arrays and an empty string.  One row per input row, repeated
    rows and null ids included; other columns are ignored; whole texts of any length."""
    @handing_back
    def run(batches):
        codec = _codec(model)
        for b in batches:
            rows = [(*r, codec.decode(r[0])) for r in codec.encode_all([t or "" for t in b.column(1).to_pylist()])]
            cols = [pa.array([r[i] for r in rows], pa.list_(pa.int32() if i == 0 else pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([r[3] for r in rows], pa.string())],
                                             ["id", "ids", "begins", "ends", "decoded"])
        codec.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, ids array<int>, begins array<long>, ends array<long>, decoded string")
    return out.withColumnRenamed("id", id_col)


def _ints(ids: str):
    """The numbers of a comma-joined text, one by one."""
    at = 0
    while at < len(ids):
        end = ids.find(",", at)
        end = len(ids) if end < 0 else end
        yield int(ids[at:end])
        at = end + 1


def _some(texts: pa.Array):
    """Texts (null: empty) in lists of about ``TOGETHER`` characters."""
    some, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        if some and size + len(t) > TOGETHER:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def encode_digests(docs: DataFrame, model: bytes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Digests of what ``encode`` returns: id_col, n_tokens, ids_sha256 (decimal ids joined
    by commas), decoded_sha256 (UTF-8), spans_sha256 (the spans as little-endian 64-bit
    begin, end).  Inputs are treated alike."""
    @handing_back
    def run(batches):
        codec = _codec(model)
        for b in batches:
            n, ids_hex, decoded_hex, spans_hex = [], [], [], []
            for some in _some(b.column(1)):
                for ids, used, plain, ends in codec.parts(some):
                    begin, end = codec.spans(used, ends)
                    n.append(len(begin))
                    decoded = codec.strip_prefix(plain, _ints(ids))
                    ids_hex.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded_hex.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    spans_hex.append(hashlib.sha256(np.column_stack([begin, end]).astype("<i8").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()),
                                              pa.array(decoded_hex, pa.string()), pa.array(spans_hex, pa.string())],
                                             ["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])
        codec.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
    return out.withColumnRenamed("id", id_col)
