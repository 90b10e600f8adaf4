"""Texts as sequences of numbered distinct words, and codes gathered by number (Arrow and numpy).

A column of texts is split and its words numbered by Arrow, so Python objects exist for distinct words
only; what belongs to a word (token ids, bytes) is then laid out for whole texts with numpy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbered_words(texts: pa.Array, odd: np.ndarray, cut: Callable[[str], list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, word numbers of all texts, offsets per text).  A text is cut at every space; where ``odd`` is
    set, ``cut(text)`` gives its words.  Empty and null texts have no words."""
    blank = pc.fill_null(texts, "")
    lists = pc.split_pattern(blank, " ")
    coded = lists.flatten().dictionary_encode()
    words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    drop = pc.equal(blank, "").to_numpy(zero_copy_only=False)
    if not (odd | drop).any():
        return words, index, offsets
    number = {w: i for i, w in enumerate(words)}
    parts, sizes = [], np.diff(offsets)
    start = 0
    for i in np.flatnonzero(odd | drop).tolist():
        parts.append(index[start : offsets[i]])
        own = [] if drop[i] else cut(blank[i].as_py())
        for w in own:
            if w not in number:
                number[w] = len(words)
                words.append(w)
        parts.append(np.array([number[w] for w in own], dtype=np.int64))
        sizes[i] = len(own)
        start = offsets[i + 1]
    parts.append(index[start:])
    return words, np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))


class Codes:
    """Variable-length codes by number, side by side."""

    def __init__(self, parts: list[bytes], kind: np.dtype):
        kind = np.dtype(kind)
        self.flat = np.frombuffer(b"".join(parts), dtype=kind)
        self.sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // kind.itemsize
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, flat: np.ndarray, sizes: np.ndarray) -> Codes:
        out = cls.__new__(cls)
        out.flat, out.sizes, out.starts = flat, sizes, np.cumsum(sizes) - sizes
        return out

    def gather(self, index: np.ndarray) -> np.ndarray:
        """The codes of a sequence of numbers, one after another."""
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return self.flat[:0]
        shift = (self.starts[index] - (ends - sizes)).astype(np.int32 if len(self.flat) < 1 << 30 and ends[-1] < 1 << 30 else np.int64)
        return self.flat[np.repeat(shift, sizes) + np.arange(ends[-1], dtype=shift.dtype)]
