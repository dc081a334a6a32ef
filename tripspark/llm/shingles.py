"""Word shingles of whole texts as 64-bit fingerprints, for Python code inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xBF58476D1CE4E5B9)
_MEMO_WORDS = 500_000


class _WordPrints(dict):
    """Fingerprints of words seen by this worker; starts again when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_prints = _WordPrints()
word_print = _prints.__getitem__


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; a null text has none."""
    # bytes.lower() changes A-Z only and bytes.split() knows no other white space than space, 9-13.
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct fingerprints of all shingles; fewer words than a shingle are one shingle."""
    words = ascii_lower_words(text)
    if not words:
        return np.empty(0, np.int64)
    prints = np.fromiter(map(_prints.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE_WORDS, len(words))
    last = len(words) - width
    mixed = prints[: last + 1] ^ np.uint64(width)
    for at in range(1, width):
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _SPREAD + prints[at : last + 1 + at]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _FINISH
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))
