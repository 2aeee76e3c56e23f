"""Words, shingles and their 64-bit hashes for batches of texts, vectorised with numpy."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash

#: A word is a maximal run of letters and digits; an underscore separates words.
WORD = re.compile(r"[^\W_]+")
_KEEP = 400_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _KEEP:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASH = _Hashes()


def words(text: str | None) -> list[str]:
    """The lower-cased words of a text; none for a null."""
    return WORD.findall(text.lower()) if text else []


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in order, and the number of words of each text."""
    lists = [words(t) for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(map(_HASH.__getitem__, chain.from_iterable(lists)), np.uint64, int(lengths.sum()))
    return flat, lengths


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``k`` successive words; empty if it has fewer words."""
    flat, lengths = word_hashes(texts)
    n = len(flat) - k + 1
    if n <= 0:
        return [np.zeros(0, np.uint64) for _ in texts]
    with np.errstate(over="ignore"):
        h = flat[:n].copy()
        for i in range(1, k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[i : i + n])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    return [np.unique(h[s : e - k + 1]) if e - s >= k else np.zeros(0, np.uint64) for s, e in zip(starts.tolist(), ends.tolist())]
