"""Token ids of whole texts with a public tokenizer.

A tokenizer that splits at white space and treats each word by itself needs to encode
a word once: it is found again in a table, by the 64-bit hash of its bytes; that two of
a worker's words share a hash has a chance under 1e-6 in all. If the tokenizer also cuts
before closing punctuation, a word shares the entry of the word without it, and if it
lower-cases ASCII letters, that of the small word. Which of this holds is tried out on
PROBES when an encoder is made; for a tokenizer that doesn't split so, whole texts go to
the library.
"""

from __future__ import annotations

import os
import sys

import numpy as np

from .common import words

_TAIL = b".,!?;:#$%&*"
_SLOTS = 1 << 21
_MOST_WORDS = _SLOTS // 2
#: Words looked up at once: each may add two entries, and the table still has room.
_AT_ONCE = _SLOTS // 8
#: Words that tell how a tokenizer behaves.
PROBES = ("Hello", "WORLD", "the", "Zebras", "x9", "Antidisestablishmentarianism", "I", "don't", "2024", "naïve", "ab-cd")
_U = np.uint64


class _Growing:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 16, kind), 0

    def extend(self, values) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class WordEncoder:
    """Ids of texts, equal to the library's for the whole text. Memory is bounded: a full table starts anew."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        gaps = (" ", "  ", "\n", " \t\r\n\x0b\x0c ")
        self.by_word = all(one(f"{g}{a}{g}{b}{g}") == one(a) + one(b) for g in gaps for a, b in zip(PROBES, PROBES[1:], strict=False))
        self.cuts = all(one(a + t) == one(a) + one(t) for a in PROBES for t in [*_TAIL.decode(), ".,", "!!"])
        self.lowers = all(one(a) == one(a.lower()) for a in PROBES)
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(_SLOTS, _U), np.zeros(_SLOTS, np.int32)
        self.starts, self.lengths, self.flat = _Growing(np.int64), _Growing(np.int64), _Growing(np.int32)

    def _find(self, hashed: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1. Open addressing, all probes at once."""
        out = np.full(len(hashed), -1, np.int32)
        slot = (hashed & _U(_SLOTS - 1)).astype(np.int64)
        left = np.arange(len(hashed))
        while len(left):
            there = self.keys[slot]
            hit = there == hashed[left]
            out[left[hit]] = self.entry[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & (_SLOTS - 1)
        return out

    def _insert(self, hashed: np.ndarray, ids: list[list[int]]) -> None:
        """New entries; the hashes are distinct and not in the table."""
        number = np.arange(self.starts.n, self.starts.n + len(hashed), dtype=np.int32)
        sizes = np.array([len(x) for x in ids], np.int64)
        self.starts.extend(self.flat.n + np.cumsum(sizes) - sizes)
        self.lengths.extend(sizes)
        self.flat.extend(np.array([i for x in ids for i in x], np.int32))
        slot = (hashed & _U(_SLOTS - 1)).astype(np.int64)
        left = np.arange(len(hashed))
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.keys[slot[placed]], self.entry[slot[placed]] = hashed[left[placed]], number[left[placed]]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, slot = left[rest], (slot[rest] + 1) & (_SLOTS - 1)

    def _ids(self, entry: int) -> list[int]:
        a = self.starts.data[entry]
        return self.flat.data[a : a + self.lengths.data[entry]].tolist()

    def _library(self, parts: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of single words: from the table, else from the library, which fills the table."""
        data = np.frombuffer(b" ".join(parts), np.uint8)
        hashed = words(data, np.array([0, len(data)]), lower=False)[0]
        entry = self._find(hashed)
        new = np.flatnonzero(entry < 0)
        found = self.tokenizer.encode_batch_fast([parts[i].decode() for i in new], add_special_tokens=False) if len(new) else []
        ids = [x.ids for x in found]
        self._insert(hashed[new], ids)
        out = {parts[i]: x for i, x in zip(new, ids, strict=True)}
        return out | {parts[i]: self._ids(entry[i]) for i in np.flatnonzero(entry >= 0)}

    def _learn(self, texts: list[bytes], hashed: np.ndarray) -> None:
        split, parts = [], {}
        for w in texts:
            root = w.rstrip(_TAIL) if self.cuts else w
            if not root or not root[-1:].isalnum():
                root = w
            tail = w[len(root) :]
            if self.lowers and root.isalpha():
                root = root.lower()
            split.append((root, tail))
            parts[root] = None
            if tail:
                parts[tail] = None
        known = self._library(list(parts))
        still = np.flatnonzero(self._find(hashed) < 0)
        self._insert(hashed[still], [known[split[i][0]] + known.get(split[i][1], []) for i in still])

    def _entries(self, data: np.ndarray, hashed: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        entry = self._find(hashed)
        new = np.flatnonzero(entry < 0)
        if len(new):
            distinct, at = np.unique(hashed[new], return_index=True)
            some = new[at]
            self._learn([data[b : b + n].tobytes() for b, n in zip(begin[some], size[some], strict=True)], distinct)
            entry[new] = self._find(hashed[new])
        return entry

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (int32), and where each text's begin, with one entry more."""
        if not self.by_word:
            texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        hashed, first, begin, size = words(data, offsets, lower=False)
        parts, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a in range(0, len(hashed), _AT_ONCE):
            if self.starts.n > _MOST_WORDS:
                self.clear()
            some = slice(a, a + _AT_ONCE)
            entry = self._entries(data, hashed[some], begin[some], size[some])
            n = self.lengths.data[entry]
            ends = np.cumsum(n)
            parts.append(self.flat.data[np.repeat(self.starts.data[entry] - ends + n, n) + np.arange(n.sum())])
            lengths.append(n)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
        return np.concatenate(parts), ends[first]


def encoder(path: str) -> WordEncoder:
    """This Python worker's encoder: it outlives a task, and so does its cache."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = sys.__dict__.setdefault("_casestream_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]
