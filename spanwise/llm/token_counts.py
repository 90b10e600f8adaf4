"""Operator 3, token counts: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at each position of a
word, longest first; dynamic programming carries the best score and the piece count of that path, no
back-pointers.  Distinct words are counted once per process (a bounded cache), whole texts summed.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import pieces
from spanwise.llm.unigram import LONG_WORD, Vocabulary, mark, units

CACHE_WORDS = 600_000
_LOWEST = float("-inf")
_counters: dict[int, Counter] = {}


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, (score, _) in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.cache: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces on the best path of a marked word."""
        n = len(word)
        best, count = [_LOWEST] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        pieces = self.vocabulary.pieces
        unknown = [i for i, c in enumerate(word) if c not in pieces]
        if not unknown:
            for end, (size, score) in self.automaton.iter(word):
                start = end + 1 - size
                total = best[start] + score
                if total > best[end + 1]:
                    best[end + 1], count[end + 1] = total, count[start] + 1
            return count[n]
        found: dict[int, list[tuple[int, float]]] = {}
        for end, match in self.automaton.iter(word):
            found.setdefault(end, []).append(match)
        odd = set(unknown)
        for end in range(n):
            for size, score in found.get(end, ()):
                total = best[end + 1 - size] + score
                if total > best[end + 1]:
                    best[end + 1], count[end + 1] = total, count[end + 1 - size] + 1
            if end in odd and best[end] + self.vocabulary.unknown_score > best[end + 1]:
                best[end + 1] = best[end] + self.vocabulary.unknown_score
                count[end + 1] = count[end] + len(word[end].encode())
        return count[n]

    def text(self, text: str | None) -> int:
        words = units(text or "")
        cache = self.cache
        try:
            return sum(map(cache.__getitem__, words))
        except KeyError:
            pass
        total = 0
        for w in words:
            n = cache.get(w)
            if n is None:
                n = self.word(mark(w))
                if len(w) <= LONG_WORD:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = n
            total += n
        return total


def counter(shared) -> Counter:
    """The process's counter for a broadcast vocabulary."""
    if shared.id not in _counters:
        _counters.clear()
        _counters[shared.id] = Counter(shared.value)
    return _counters[shared.id]


class _Shared:
    """A broadcast with its id (Spark's own id is not readable in tasks)."""

    def __init__(self, broadcast, id: int):
        self.broadcast, self.id = broadcast, id

    @property
    def value(self):
        return self.broadcast.value


def share(spark, vocabulary: Vocabulary) -> _Shared:
    broadcast = spark.sparkContext.broadcast(vocabulary)
    return _Shared(broadcast, broadcast._jbroadcast.id())


def token_counts(docs: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_chars) of every row; null and empty texts have 0 of both.

    Rows that repeat a doc_id are counted each on their own; null ids stay null; other columns are
    ignored.
    """
    shared = share(docs.sparkSession, vocabulary or Vocabulary.load())
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        own = counter(shared)
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([own.text(t) for t in texts], pa.int64()), pa.array(np.array([len(t or "") for t in texts], dtype=np.int64))],
                ["doc_id", "n_tokens", "n_chars"])

    kind = dict(base.dtypes)["doc_id"]
    return base.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_chars long")
