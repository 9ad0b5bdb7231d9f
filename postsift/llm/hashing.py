"""Vectorised 64-bit hashing of words, word shingles and sets (numpy, inside tasks).

Words are the runs of ``[^\\x20\\x09-\\x0D]``; that class is ASCII, so the work is done on
UTF-8 bytes.  A word's hash is a polynomial over a table of random byte values, finished
with a 64-bit mixer; equal words have equal hashes in every process.  Two different
values collide with probability 2**-64.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_W1, _W2 = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
# A text is hashed in pieces of about this many bytes, cut at white space.
PIECE_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * _BASE)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _pieces(b: np.ndarray):
    at, n = 0, len(b)
    while n - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < n:                      # the next white space, looked for in steps
            hit = np.flatnonzero(_SPACE[b[end:end + 65536]])
            if len(hit):
                end += int(hit[0])
                break
            end = min(n, end + 65536)
        yield b[at:end]
        at = end
    yield b[at:]


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """One hash per word, in order (empty for null).  ``lower`` maps A-Z to a-z."""
    if not text:
        return np.empty(0, U)
    out = []
    for b in _pieces(np.frombuffer(utf8(text), np.uint8)):
        space = _SPACE[b]
        first = ~space
        first[1:] &= space[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        value = (_LOWER if lower else _BYTE)[b]
        value[space] = 0
        bounds = np.append(starts, len(b))
        widths = np.diff(bounds)
        at = np.arange(starts[0], len(b)) - np.repeat(starts, widths)
        powers = np.cumprod(np.full(int(widths.max()), _BASE, U))
        out.append(mix(np.add.reduceat(value[starts[0]:] * powers[at], starts - starts[0])))
    return np.concatenate(out) if out else np.empty(0, U)


def shingle_set(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; with fewer words (but at
    least one) the whole sequence as one; empty without words."""
    w = word_hashes(text)
    n = len(w)
    if n == 0:
        return w
    k = min(width, n)
    h = np.zeros(n - k + 1, U)
    for j in range(k):
        h = mix(h * _W1 + w[j:n - k + 1 + j] * _W2 + U(j + 1))
    return np.unique(h if k == width else mix(h + U(k)))


def set_key(values: np.ndarray) -> int:
    """Signed 64-bit key of a sorted set: equal sets have equal keys."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)
