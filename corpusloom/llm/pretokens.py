"""Pre-tokens of byte-level BPE, found for a whole chunk of documents at once.

The pattern in words: an apostrophe with s, t, re, ve, m, ll or d; runs of
letters, of numbers, or of other signs, each with one blank before it if there is
one; a run of white space, whose last character is left out where a word follows.
All of it depends only on the runs of character classes, so numpy can mark the
starts of the pre-tokens without a regular expression.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Code points of the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that an apostrophe may take.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = classes()
    out = table[data]
    if not len(data) or data.max() < 0x80:
        return out
    wide = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
    for low, high, width, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0xF8, 4, 0x07)):
        at = np.flatnonzero((data >= low) & (data < high))
        code = wide[at] & mask
        for k in range(1, width):
            code = code << 6 | wide[at + k] & 0x3F
        kind = table[np.minimum(code, 0x10FFFF)]
        for k in range(width):
            inside = at + k < len(data)
            out[at[inside] + k] = kind[inside]
    return out


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions at which a pre-token starts; each ends where the next one starts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = edge.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    change[n] = True
    runs = np.flatnonzero(change[:n])
    run_kind = kind[runs]
    run_end = np.append(runs[1:], n)
    starts = np.zeros(n + 1, bool)

    white = run_kind == SPACE
    starts[runs[white]] = True
    follows = white & ~edge[run_end]
    last = run_end[follows] - 1
    while (more := data[last] & 0xC0 == 0x80).any():
        last = last - more
    starts[last] = True

    words = runs[~white]
    blank = np.zeros(len(words), bool)
    inner = ~edge[words]
    blank[inner] = data[words[inner] - 1] == 32
    starts[words[~blank]] = True

    alone = words[(data[words] == 39) & ~blank & (run_end[~white] == words + 1)]
    alone = alone[(alone + 1 < n) & ~edge[np.minimum(alone + 1, n)]]
    for ending in ENDINGS:
        size = len(ending)
        at = alone[alone + size < n]
        fits = np.ones(len(at), bool)
        for k, letter in enumerate(ending, 1):
            fits &= (data[at + k] == ord(letter)) & ~edge[at + k]
        at = at[fits]
        starts[at + 1] = False
        starts[at + 1 + size] = True
    return np.flatnonzero(starts[:n])
