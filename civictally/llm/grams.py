"""Word hashes and windows of many texts at once, in numpy."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multiplier of the window hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_WORDS = re.compile(r"[^\W_]+")


def space_words(text: str | None) -> list[str]:
    """Maximal runs of non-white-space."""
    return text.split() if text else []


def letter_words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _WORDS.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def hash_words(words: list[str]) -> np.ndarray:
    """64-bit hash of each word, the same in every process."""
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=True)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values of ``words``."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(BASE, n), out=total[1:])
    return mix((total[width:] - total[:-width]) * _powers(INVERSE, n - width + 1))


def whole_windows(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end with so many words each: which windows lie within one
    text (positions in the joint array), and the number of that text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(owner) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return at, owner[at]
