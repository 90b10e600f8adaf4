"""Operator 7, SentencePiece encoding and decoding: shared-prefix Viterbi.

A batch's distinct words that are not known yet are marked, sorted (the order of a depth-first walk
of their trie) and encoded one after another: forward scores and back-pointers of the prefix that a
word shares with the one before it are reused, and only the rest of the word is computed, from the pieces
that an automaton over the vocabulary finds to end there.  Known words are kept in a cache of the process that is
bounded in bytes; texts are the concatenation of their words' ids, laid out with numpy.
"""

from __future__ import annotations

from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanwise.llm.common import give_back, pieces
from spanwise.llm.token_counts import share
from spanwise.llm.unigram import LONG_WORD, MARK, Vocabulary, units
from spanwise.llm.wordcode import Codes, numbered_words

CACHE_BYTES = 32 << 20  # known words and their ids, with the objects that hold them
WORD_BYTES = 180  # of a cached word: its entry, its text and its ids as objects
ENCODE_BYTES = 4 << 20  # texts encoded together: their new words are held at once
GATHER_BYTES = 1 << 20  # texts laid out together
_coders: dict[int, Coder] = {}


class Coder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.cache: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, (score, i) in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.longest = max(map(len, vocabulary.pieces), default=1)
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.bytes = Codes(vocabulary.by_id, np.uint8)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, their number per word) of sorted, distinct, marked words."""
        odd = set("".join(words)) - self.single  # characters that are no pieces
        find, reach = self.automaton.iter, self.longest - 1
        best, via = [0.0], [None]  # per position of the word: best score, (size, score, id) of the piece that ends there
        flat, sizes, before = array("i"), array("q"), ""
        for word in words:
            same = 0
            for x, y in zip(before, word):  # noqa: B905 - words of different length
                if x != y:
                    break
                same += 1
            del best[same + 1 :], via[same + 1 :]
            if not odd or odd.isdisjoint(word):  # a piece ends at every position: the longest comes first
                filled = same
                for at, match in find(word, same - reach if same > reach else 0):
                    if at < same:
                        continue
                    total = best[at + 1 - match[0]] + match[1]
                    if at == filled:
                        best.append(total)
                        via.append(match)
                        filled += 1
                    elif total > best[at + 1]:
                        best[at + 1], via[at + 1] = total, match
            else:
                self._rest(word, same, best, via)
            path, at = [], len(word)
            while at:
                size, _, piece = via[at]
                if piece >= 0:
                    path.append(piece)
                else:
                    path.extend([self.vocabulary.byte_ids[b] for b in reversed(word[at - 1].encode())])
                at -= size
            path.reverse()
            flat.extend(path)
            sizes.append(len(path))
            before = word
        return np.array(flat, dtype=np.int32), np.array(sizes, dtype=np.int64)

    def _rest(self, word: str, same: int, best: list[float], via: list) -> None:
        """Positions after ``same`` of a word with characters that are no pieces."""
        ending: dict[int, list[tuple[int, float, int]]] = {}
        for at, match in self.automaton.iter(word, max(0, same - self.longest + 1)):
            ending.setdefault(at, []).append(match)
        for at in range(same, len(word)):
            top, found = float("-inf"), None
            for match in ending.get(at, ()):
                if best[at + 1 - match[0]] + match[1] > top:
                    top, found = best[at + 1 - match[0]] + match[1], match
            if word[at] not in self.single and best[at] + self.vocabulary.unknown_score > top:
                top, found = best[at] + self.vocabulary.unknown_score, (1, self.vocabulary.unknown_score, -1)
            best.append(top)
            via.append(found)

    def _codes(self, words: list[str], times: np.ndarray) -> tuple[Codes, np.ndarray]:
        """Ids of distinct unmarked words, and each word's place among them.  Words that occur more than once are kept."""
        cache = self.cache
        old = [i for i, w in enumerate(words) if w in cache]
        mask = np.ones(len(words), dtype=bool)
        mask[old] = False
        new = np.flatnonzero(mask).tolist()
        marked = [MARK + words[i] for i in new]
        if " " in "".join(marked):
            marked = [m.replace(" ", MARK) for m in marked]
        order = sorted(range(len(new)), key=marked.__getitem__)
        flat, sizes = self.words([marked[k] for k in order])
        known = Codes([cache[words[i]] for i in old], np.int32)
        place = np.empty(len(words), dtype=np.int64)
        place[old] = np.arange(len(old))
        ranked = np.array(new, dtype=np.int64)[order] if new else np.empty(0, np.int64)
        place[ranked] = len(old) + np.arange(len(new))
        again = [(k, words[i]) for k, i in enumerate(ranked.tolist()) if times[i] > 1 and len(words[i]) <= LONG_WORD]
        if (len(cache) + len(again)) * WORD_BYTES > CACHE_BYTES:
            cache.clear()
        if len(again) * WORD_BYTES <= CACHE_BYTES:
            ends = np.cumsum(sizes)
            cache.update((w, flat[ends[k] - sizes[k] : ends[k]].tobytes()) for k, w in again)
        return Codes.of(np.concatenate((known.flat, flat)), np.concatenate((known.sizes, sizes))), place

    def encode_column(self, texts: pa.Array, check: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(ids of all texts, their number per text, whether each decodes to its text)."""
        plain = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        odd = pc.or_(pc.match_substring_regex(plain, "^ | $"), pc.match_substring(plain, "  "))
        words, index, offsets = numbered_words(plain, odd.to_numpy(zero_copy_only=False), units)
        codes, place = self._codes(words, np.bincount(index, minlength=len(words)))
        index = place[index]
        ends = np.concatenate(([0], np.cumsum(codes.sizes[index])))[offsets]
        ids, same = [], []
        sizes = np.cumsum(pc.binary_length(plain.cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(plain):
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + GATHER_BYTES, side="right")))
            ids.append(codes.gather(index[offsets[start] : offsets[end]]))
            if check:
                same.append(self._decodes(ids[-1], ends[start : end + 1] - ends[start], pc.fill_null(texts[start:end], "")))
            start = end
        return np.concatenate(ids) if ids else np.empty(0, np.int32), np.diff(ends), np.concatenate(same) if same else None

    def _decodes(self, ids: np.ndarray, ends: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Per text: are its bytes those of its ids, but for the mark put in front?"""
        joined = self.bytes.gather(ids)
        at = np.concatenate(([0], np.cumsum(self.bytes.sizes[ids])))[ends]
        raw = texts.cast(pa.binary())
        sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        right = np.diff(at) == sizes + (sizes > 0)
        if right.all():
            rest = np.ones(len(joined), dtype=bool)
            rest[at[:-1][sizes > 0]] = False
            if joined[rest].tobytes() == b"".join(raw.to_pylist()):
                return right
        whole = joined.tobytes()
        return np.array([whole[a:b][1:] == x for a, b, x in zip(at, at[1:], raw.to_pylist(), strict=False)], dtype=bool)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, sizes, _ = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def decode(self, ids: np.ndarray) -> str:
        table = self.vocabulary.by_id
        return b"".join([table[i] for i in ids.tolist()]).decode(errors="replace")[1:]


def _coder(shared) -> Coder:
    if shared.id not in _coders:
        _coders.clear()
        _coders[shared.id] = Coder(shared.value)
    return _coders[shared.id]


def _let_go() -> None:
    """Drop the process's coder.  A function of the module: what is nested in ``_added`` is sent to the tasks by value,
    with a ``_coders`` of its own."""
    _coders.clear()
    give_back()


def _added(docs: DataFrame, fields: list[T.StructField], make, column: str | None = None) -> DataFrame:
    """docs with the new columns (replacing those of their names) from ``make(batch)``, a piece of a batch at a time.
    A task's automaton and cached words are let go at its end, as the Python process waits or serves other operators next."""
    names = [f.name for f in fields]
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *fields])

    def run(batches):
        try:
            for batch in pieces(batches, column, ENCODE_BYTES) if column else batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], [*batch.schema.names, *names])
        finally:
            _let_go()

    return docs.mapInArrow(run, schema)


def encoded(docs: DataFrame, vocabulary: Vocabulary | None = None, text_col: str = "text", out_col: str = "ids",
            check_col: str | None = None) -> DataFrame:
    """``docs`` with the token ids of its text (array<int>); null and empty texts have no ids.

    ``check_col``: also decode the ids and add whether that gives the text back (a null text: '')."""
    shared = share(docs.sparkSession, vocabulary or Vocabulary.load())

    def make(batch):
        ids, sizes, same = _coder(shared).encode_column(batch.column(text_col), check_col is not None)
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
        return [*made, pa.array(same, pa.bool_())] if check_col else made

    fields = [T.StructField(out_col, T.ArrayType(T.IntegerType()))]
    if check_col:
        fields.append(T.StructField(check_col, T.BooleanType()))
    return _added(docs, fields, make, text_col)


def decoded(docs: DataFrame, vocabulary: Vocabulary | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of its token ids; null ids give null.  Decoding gives back the encoded
    text, except that a literal mark character (U+2581) comes back as a space."""
    shared = share(docs.sparkSession, vocabulary or Vocabulary.load())

    def make(batch):
        coder, column = _coder(shared), batch.column(ids_col)
        flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
        valid = column.is_valid().to_pylist()
        return [pa.array([coder.decode(flat[a:b]) if ok else None for a, b, ok in zip(offsets, offsets[1:], valid, strict=False)], pa.string())]

    return _added(docs, [T.StructField(out_col, T.StringType())], make)
