"""Distinct word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from corpusloom.llm import _bytes as B

WORDS = 5
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_FOLDED = B.BYTE_HASH[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = B.mix64(np.arange(11, 11 + WORDS, dtype=np.uint64) * B._ODD) | np.uint64(1)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; none crosses a document."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each document its sorted distinct shingle hashes.

    A-Z count as a-z. A text of fewer than five words has one shingle, the whole
    sequence; a text without words has none.
    """
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n
    starts, ends = word_spans(data, offsets)
    words = B.hash_spans(data, starts, ends, _FOLDED)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled += words[k : k + len(rolled)] * _PLACE[k]
    rolled = B.mix64(rolled)
    out = []
    for d in range(n):
        a, m = first[d], count[d]
        if m >= WORDS:
            out.append(np.unique(rolled[a : a + m - WORDS + 1]))
        elif m:
            whole = (words[a : a + m] * _PLACE[:m]).sum(dtype=np.uint64) + np.uint64(m)
            out.append(B.mix64(B.mix64(np.array([whole], np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
