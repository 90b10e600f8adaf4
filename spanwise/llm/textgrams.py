"""Vectorised words and word n-grams of whole texts (numpy, used inside Spark tasks).

A batch of texts is one byte array.  Words are maximal runs of bytes outside ``0x20`` and
``0x09``-``0x0D``, with ``A``-``Z`` lower-cased; every word gets a 64-bit hash from a prefix sum
(polynomial hash modulo 2^64, finalised), so no Python object is made per word.  An n-gram's hash
combines the hashes of its words.  Equal word sequences always get equal hashes, in every task and
process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5  # words of a shingle
SLICE_BYTES = 1 << 20  # texts are hashed in slices of about this many bytes

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NOT_WORD = np.array([not (b >= 0x80 or chr(b).isalnum()) for b in range(256)])  # ASCII punctuation too
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_COMBINE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                     0x589965CC75374CC3], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept per process."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES * 5 // 4)
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if size <= 2 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about SLICE_BYTES together; a longer text is a run of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > SLICE_BYTES:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


class Words:
    """All words of a run of texts: hashes, byte spans in the joined buffer, words per text."""

    def __init__(self, texts: list[bytes], punctuation: bool = True):
        """punctuation: only white space separates words; else ASCII punctuation does as well."""
        buf = self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        word = ~(_SPACE if punctuation else _NOT_WORD)[buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]  # the last byte is a separator: as many ends as starts
        n = len(buf)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_LOWER[buf].astype(np.uint64) + np.uint64(1)) * _power("inverse", _INVERSE, n), out=prefix[1:])
        self.hashes = mix((prefix[self.ends] - prefix[self.starts]) * _power("base", _BASE, n)[self.starts])
        self.offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.counts = np.diff(np.searchsorted(self.starts, self.offsets))

    def breaks(self) -> tuple[np.ndarray, np.ndarray]:
        """Per word: does a sentence end with it (``.``, ``!``, ``?`` or the end of its line), does a line."""
        newline = np.concatenate(([0], np.cumsum(self.buf == 10)))
        after = np.concatenate((self.starts[1:], [len(self.buf)]))
        line = newline[after] > newline[self.ends]
        return line | np.isin(self.buf[self.ends - 1], (33, 46, 63)), line

    def run_hashes(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words [first, end) for each pair of word numbers."""
        n = len(self.hashes)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hashes * _power("inverse", _INVERSE, n), out=prefix[1:])
        return mix(((prefix[end] - prefix[first]) * _power("base", _BASE, n + 1)[first]) ^ mix((end - first).astype(np.uint64)))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and per text the number of its words."""
    words = Words(texts)
    return words.hashes, words.counts


def combine(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of WORDS consecutive words (the caller drops runs across texts)."""
    m = len(words) - WORDS + 1
    total = np.zeros(max(m, 0), dtype=np.uint64)
    for k in range(WORDS):
        if m > 0:
            total += words[k : k + m] * _COMBINE[k]
    return mix(total)


def _short(words: np.ndarray) -> np.uint64:
    """Hash of a sequence of fewer than WORDS words."""
    total = np.full(1, len(words), dtype=np.uint64)
    for k, w in enumerate(words):
        total += np.full(1, w, dtype=np.uint64) * _COMBINE[k]
    return mix(mix(total))[0]


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingle hashes: WORDS-word runs; the whole sequence when there
    are fewer words; empty without words."""
    for a, b in slices(texts):
        words, counts = word_hashes(texts[a:b])
        grams = combine(words)
        at = 0
        for c in counts.tolist():
            if c >= WORDS:
                yield np.unique(grams[at : at + c - WORDS + 1])
            elif c:
                yield np.array([_short(words[at : at + c])], dtype=np.uint64)
            else:
                yield np.empty(0, dtype=np.uint64)
            at += c
