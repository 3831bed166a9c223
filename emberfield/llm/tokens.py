"""Byte-level BPE of a tokenizers .json file, run by tiktoken's engine over that file's own vocabulary.

Both libraries give the same ids: a byte-level vocabulary's ids are its merge order (tests compare them on every kind
of text). A text is cut before each space that a non-space character follows. No pre-token of the byte-level pattern
spans such a place and none looks past it, so the pieces' encodings, joined, are the text's.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import tiktoken

CUT = re.compile(r" (?=\S)").split
#: A worker remembers at most so many pieces, each of at most KEEP characters.
CACHE, KEEP = 300_000, 48

_loaded: dict[str, tuple] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def encoding(path: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """The encoder of a .json file and its added strings, loaded once per worker."""
    if path not in _loaded:
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        _loaded[path] = (tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added), added)
    return _loaded[path]


class Lengths:
    """Token counts of pieces from two tiers: a given table of frequent pieces, then a bounded cache of encoded misses."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        self.enc, self.added = encoding(path)
        self.base = frequent or {}
        self.cache = dict(self.base)
        self.misses = 0
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    def of(self, texts: list[str]) -> list[int]:
        cut = [self._cut(t) for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.cache)
        if len(self.cache) + len(new) > CACHE + len(self.base):
            self.cache = dict(self.base)
            new = set(chain.from_iterable(cut)).difference(self.cache)
        self.misses += len(new)
        encode, known = self.enc.encode_ordinary, self.cache
        known.update((p, len(encode(p))) for p in new)
        out = [sum(map(known.__getitem__, c)) for c in cut]
        for p in new:
            if len(p) > KEEP:
                del known[p]
        return out

    def _cut(self, text: str) -> list[str]:
        if self.special is not None and any(s in text for s in self.added):
            parts = self.special.split(text)
            return [p for x in parts[::2] for p in self._plain(x)] + self._one(len(parts) // 2)
        return self._plain(text)

    def _one(self, n: int) -> list[str]:
        """n pieces of one token each, for n added strings."""
        self.cache.setdefault("\n", 1)
        return ["\n"] * n

    @staticmethod
    def _plain(text: str) -> list[str]:
        first, *rest = CUT(text)
        return [first, *[" " + x for x in rest]]


def batches_of(texts: list[str], chars: int = 2_000_000):
    """Slices of texts of about so many characters."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)
