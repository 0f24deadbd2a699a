"""Byte-level BPE ids of whole texts, fast on repeated words.

A text is cut before single spaces and each unit (a space and what follows) is
encoded once and remembered, since no merge crosses such a cut. Texts with runs
of white space around a space, where a cut could change the ids, are encoded
whole.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array

import public_tokenizers
import tiktoken

RANKS = "byte_bpe_50k.tiktoken"
#: Units remembered in a Python worker at most (some 60 MB); others are encoded each time.
REMEMBERED = 300_000
#: The text after white space and a space goes on with white space or ends: cuts there aren't safe.
UNSAFE = re.compile(r" (?=\s|$)(?:(?<=\s )|(?<=^ ))")


class Units(dict):
    """Unit -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        ids = array("I", self.encoding.encode_ordinary(text))
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(unit)
        if len(self) < REMEMBERED and len(unit) < 64:
            self[unit] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if UNSAFE.search(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        return b"".join([self[first] if first else b"", *[self[" " + w] for w in rest]])


_units: dict[str, Units] = {}


def units(path: str | None = None) -> Units:
    """The encoder of this Python process for a ranks file (a parameter; the public one unless given)."""
    path = path or public_tokenizers.path(RANKS)
    if path not in _units:
        _units[path] = Units(path)
    return _units[path]
