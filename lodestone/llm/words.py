"""Vectorised word hashing for the operators that work on batches in Python."""

from __future__ import annotations

import string

import numpy as np
from xxhash import xxh64_intdigest

_LOWER = bytes(range(256)).lower()
_MARKS = string.punctuation.encode()


def plain_words(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased and ASCII punctuation deleted."""
    return (text or b"").translate(_LOWER, _MARKS).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def gram_hashes(hashes: np.ndarray, n: int, by: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``n`` words; none if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = hashes[:count].copy()
        for k in range(1, n):
            total = total * np.uint64(by) + hashes[k : k + count]
    return mix(total)


def segments(texts: list[bytes | None], words_of, size: int, reach: int):
    """Batches of text parts: (text number, first word, words, hashes) lists of about ``size`` words.

    A long text is cut into parts that share ``reach`` words, so that any run of
    up to ``reach`` words lies whole in one part.
    """
    held, total = [], 0
    for t, text in enumerate(texts):
        words = words_of(text)
        for offset in range(0, max(1, len(words) - reach), size):
            if part := words[offset : offset + size + reach]:
                held.append((t, offset, part, word_hashes(part)))
                total += len(part)
                if total >= size:
                    yield held
                    held, total = [], 0
    if held:
        yield held
