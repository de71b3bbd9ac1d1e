"""Token ids by the tokenizers library, asked once for each distinct pre-token.

A byte-level BPE treats each pre-token alone, so the library's model merges the
distinct ones and numpy puts their ids in the places of the text. The model sees
bytes as letters, as the library's byte-level step writes them. ``encode_added``
also finds the file's added tokens.
"""

from __future__ import annotations

import re

import numpy as np

from corpusloom.llm import _bytes as B
from corpusloom.llm.pretokens import pretoken_starts

#: Distinct pre-tokens that a worker remembers before it starts anew; so it does at 8 times as many ids of theirs.
REMEMBERED = 1 << 20
#: Bytes of documents that are encoded together, few, so that temporaries stay small.
ENCODED_BYTES = B.CHUNK_BYTES // 4


def byte_letters() -> dict[int, str]:
    """The letter of each byte: visible ones of Latin-1 stand for themselves, the others follow from U+0100 on."""
    visible = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class LibraryTokens:
    """A tokenizer file and the ids of the pre-tokens met so far; one for each Python worker."""

    _open: dict[str, LibraryTokens] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, byte_letters()
        added = self.library.get_added_tokens_decoder()
        self.odd = [t.content for t in added.values() if t.single_word or t.lstrip or t.rstrip or t.normalized]
        self.added = {t.content.encode(): i for i, t in added.items()}
        #: Added tokens with a blank in them may lie across the pieces of a long text.
        self.spaced = any(b" " in t or b"\n" in t for t in self.added)
        self.match = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)))
        self._forget()

    @classmethod
    def of(cls, path: str) -> LibraryTokens:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _forget(self) -> None:
        #: Ascending hashes of the pre-tokens, and where the ids of each lie in ``flat``; arrays, as a dict of Python numbers is several times as large.
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, place: np.ndarray, pieces: list[bytes]) -> None:
        """Insert ascending ``keys`` before the places given."""
        ids = [[t.id for t in self.model.tokenize(p.decode("latin-1").translate(self.letters))] for p in pieces]
        size = np.array([len(i) for i in ids], np.int32)
        self.keys = np.insert(self.keys, place, keys)
        self.begin = np.insert(self.begin, place, len(self.flat) + np.cumsum(size, dtype=np.int64) - size)
        self.size = np.insert(self.size, place, size)
        self.flat = np.concatenate((self.flat, np.array([x for i in ids for x in i], np.int32)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a chunk and the offsets of each document in them."""
        return B.by_pieces(self._encode, data) if B.is_long(offsets) else self._encode(data, offsets)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = pretoken_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        keys = B.span_hash(B.prefix_hash(B.BYTE_HASH[data]), starts, ends)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED or len(self.flat) > 8 * REMEMBERED:
            self._forget()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self._learn(distinct[new], place[new], [raw[a:b] for a, b in spans])
            place = place + np.cumsum(~known) - ~known
        place = place[inverse]
        size = self.size[place]
        at = np.concatenate(([0], np.cumsum(size)))
        return self.flat[B.ranges(self.begin[place], size)], at[np.searchsorted(starts, offsets)]

    def encode_added(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the file's added tokens found in the texts first, as the library does by default.

        Each stands for its id; the stretches between are encoded apart.
        """
        if self.odd:
            raise ValueError(f"added tokens with rules of their own: {self.odd}")
        if B.is_long(offsets) and not self.spaced:
            return B.by_pieces(self._encode_added, data)
        return self._encode_added(data, offsets)

    def _encode_added(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if not any(t in raw for t in self.added):
            return self._encode(data, offsets)
        met = [m for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.match.finditer(raw, a, b)]
        first, last = (np.array([m.span()[k] for m in met], np.int64) for k in (0, 1))
        cuts = np.sort(np.concatenate((offsets, first, last)))
        ids, at = self._encode(data, cuts)
        begin, size, held = at[:-1].copy(), np.diff(at), np.searchsorted(cuts, first, side="right") - 1
        begin[held], size[held] = len(ids) + np.arange(len(met)), 1
        flat = np.concatenate((ids, np.array([self.added[m[0]] for m in met], np.int32)))
        return flat[B.ranges(begin, size)], np.concatenate(([0], np.cumsum(size)))[np.searchsorted(cuts, offsets)]


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each document."""
    documents = len(at) - 1
    out = np.empty(len(ids) + documents, np.int32)
    ends = at[1:] + np.arange(documents)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[ends], out[inner] = end_id, ids
    return out, at + np.arange(documents + 1)
