"""Byte-level BPE encoding inside tasks.

The vocabulary is a ``tokenizers`` JSON file (byte-level BPE, no normaliser).  Its tokens are
turned back into bytes, and the ids in merge order serve ``tiktoken`` as ranks, which gives the
same ids several times as fast; a file for which ids and merges do not agree is refused.  The
special tokens of the file are cut out of a text first, as that library does.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

# Fixed value: the pre-tokenizer's pattern of the byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in such a file: printable Latin-1 characters for
    themselves, all other bytes for the characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@dataclass(frozen=True)
class ByteBpe:
    """A vocabulary: token bytes with their ids, and special strings with theirs."""
    tokens: tuple
    special: tuple

    def encoder(self):
        return _encoder(self)


def load(path: str) -> ByteBpe:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("not a plain byte-level BPE")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    byte = _byte_of()
    vocab = model["vocab"]
    order = [vocab["".join(m) if not isinstance(m, str) else m.replace(" ", "", 1)] for m in model["merges"]]
    if order != sorted(order) or len(set(order)) != len(order):
        raise ValueError("ids do not follow the merges")
    tokens = tuple((bytes(byte[c] for c in t), i) for t, i in vocab.items() if t not in special)
    return ByteBpe(tokens, tuple(sorted(special.items())))


@lru_cache(maxsize=2)
def _encoder(vocabulary: ByteBpe):
    """Function of a text: its ids."""
    import tiktoken

    plain = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=dict(vocabulary.tokens), special_tokens={}).encode_ordinary
    special = dict(vocabulary.special)
    if not special:
        return plain
    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for m in cut.finditer(text):
            out += [*plain(text[at:m.start()]), special[m[0]]]
            at = m.end()
        return out + plain(text[at:]) if at else plain(text)

    return encode
