"""Words of many texts as flat arrays of 64-bit hashes."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

LETTERS_DIGITS = re.compile(r"[^\W_]+")
CODE_WORDS = re.compile(r"[A-Za-z0-9_]+")

_CACHED = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """word -> signed 64-bit hash; forgets all when it has grown too large, which changes no value."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) > _CACHED:
            self.clear()
        self[word] = h
        return h


HASHES = WordHashes()


def flat_words(texts: Iterable[str | None], pattern: re.Pattern, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after the other, and the offsets at which each text's words begin (one more than texts)."""
    parts, ends = [], [0]
    get, find = HASHES.__getitem__, pattern.findall
    for t in texts:
        w = find(t.lower() if lower else t) if t else ()
        parts.append(np.fromiter(map(get, w), np.uint64, len(w)))
        ends.append(ends[-1] + len(w))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.asarray(ends, np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Each value through a 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h = h ^ (h >> np.uint64(29))
    h = h * _MIX
    return h ^ (h >> np.uint64(32))


def grams(words: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n successive words within one text, and the flat position of its first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h *= _MIX
        h += words[k : len(words) - n + 1 + k]
    inside = np.ones(len(h), bool)
    for k in range(1, n):  # a gram may not reach over a text's end
        stops = ends[1:-1] - k
        inside[stops[(stops >= 0) & (stops < len(h))]] = False
    at = np.flatnonzero(inside)
    return mixed(h[at]), at
