"""Operator 4, substring dedup: paragraph MinHash banding with exact verification.

Paragraphs are lines, and hard-wrapped blocks: lines between blank lines that are short (fewer than
LINE_WORDS words on average) or filled up to one width.  Paragraphs of at least LINE_WORDS words get
a MinHash signature of their distinct 5-word shingles; BANDS bands of ROWS values are tuned for recall
(a pair at Jaccard 0.75 collides in some band with probability 0.9986).  Colliding paragraphs are
joined, verified by exact Jaccard on whole shingle sets (0.75 or more) and clustered by connected
components; the cluster's first paragraph, by (doc_id, position), stays and the others are removed,
exact copies and near ones alike.

A repeated passage need not fill a paragraph.  Every window of MIN_WORDS words that an earlier document
has, wherever its sentences and lines end, is removed, so runs of equal words are cut at their full
length; inside one document a window counts if its last occurrence before does not overlap it (text
with a short period stays).  Only windows whose smallest hash of ANCHOR words occurs twice are
compared: equal windows have equal ones, so nothing is lost.

Lines are also cut at sentence ends, and a sentence that occurred before, word for word, is a removal
candidate too (a sentence of fewer than CONTEXT words together with the words that follow it up to
CONTEXT).  A run of consecutive candidates is removed if it has at least MIN_WORDS words; shorter
repeats (stock phrases, short lines) stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.llm import textgrams
from spanwise.llm.blocks import in_blocks, repeated
from spanwise.llm.candidates import linked_components
from spanwise.llm.common import Tables, bloom_build, bloom_has, encode, maybe_in, pieces, tidy

BANDS, ROWS = 12, 3
LINE_WORDS = 20
MIN_WORDS = 40
CONTEXT = 8
BLOCK_BYTES = 16 << 20  # text a block of keys stands for
ANCHOR = 20  # words; a window of MIN_WORDS words holds MIN_WORDS - ANCHOR + 1 of them
_rng = np.random.default_rng(4)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


class Units:
    """Sentences and lines of a run of texts."""

    def __init__(self, texts: list[bytes]):
        w = self.words = textgrams.Words(texts)
        sentence, line = w.breaks()
        self.end = np.flatnonzero(sentence) + 1  # word numbers
        self.first = np.concatenate(([0], self.end[:-1])) if len(self.end) else self.end
        word_offsets = np.concatenate(([0], np.cumsum(w.counts)))
        self.text = np.searchsorted(word_offsets, self.first, side="right") - 1
        reach = np.minimum(np.maximum(self.end, self.first + CONTEXT), word_offsets[1:][self.text])
        self.hash = w.run_hashes(self.first, reach)
        self.text_first = np.searchsorted(self.first, word_offsets)  # units of text i: [i], [i + 1]
        self.seq = np.arange(len(self.first)) - self.text_first[self.text]
        self.line_end = np.flatnonzero(line) + 1
        self.line_first = np.concatenate(([0], self.line_end[:-1])) if len(self.line_end) else self.line_end
        self.offsets = word_offsets

    def _blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """First and end word of the hard-wrapped blocks of more than one line."""
        w, first, end = self.words, self.line_first, self.line_end
        if not len(first):
            return first, end
        newline = np.concatenate(([0], np.cumsum(w.buf == 10)))
        after = np.concatenate((w.starts[end[:-1]], [len(w.buf)]))
        last = (newline[after] - newline[w.ends[end - 1]] > 1) | np.isin(end, self.offsets)
        b = np.flatnonzero(last) + 1  # line numbers
        a = np.concatenate(([0], b[:-1]))
        lines, words = b - a, end[b - 1] - first[a]
        letters = np.concatenate(([0], np.cumsum((w.buf & 0xC0) != 0x80)))
        width = letters[w.ends[end - 1]] - letters[w.starts[first]]
        word = letters[w.ends[first]] - letters[w.starts[first]]
        widest = np.maximum.reduceat(width, a)
        full = last | (width + 1 + np.append(word[1:], 0) > np.repeat(widest, lines))
        keep = (lines > 1) & ((words < LINE_WORDS * lines) | np.logical_and.reduceat(full, a))
        return first[a[keep]], end[b[keep] - 1]

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end word and hash of the lines and blocks that get a signature."""
        a, b = (np.concatenate(x) for x in zip((self.line_first, self.line_end), self._blocks(), strict=True))
        keep = b - a >= LINE_WORDS
        a, b = a[keep], b[keep]
        return a, b, self.words.run_hashes(a, b) ^ np.uint64(1)

    def windows(self) -> np.ndarray:
        """First words of all windows of MIN_WORDS words."""
        left = np.repeat(self.offsets[1:], self.words.counts) - np.arange(self.offsets[-1])
        return np.flatnonzero(left >= MIN_WORDS)

    def window_hashes(self, first: np.ndarray) -> np.ndarray:
        return self.words.run_hashes(first, first + MIN_WORDS) ^ np.uint64(2)

    def anchors(self, first: np.ndarray) -> np.ndarray:
        """Smallest hash of ANCHOR words inside each window."""
        if not len(first):
            return np.empty(0, np.uint64)
        at = np.arange(self.offsets[-1] - ANCHOR + 1)
        low, size, whole = self.words.run_hashes(at, at + ANCHOR), 1, MIN_WORDS - ANCHOR + 1
        while size < whole:
            step = min(size, whole - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        return low[first]


def _again(first: np.ndarray, key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Mask of the windows that their own text has before, the last time without overlap."""
    order = np.lexsort((first, text, key))
    f, k, t = first[order], key[order], text[order]
    out = np.zeros(len(first), dtype=bool)
    out[order[1:]] = (k[1:] == k[:-1]) & (t[1:] == t[:-1]) & (f[1:] - f[:-1] >= MIN_WORDS)
    return out


def _bands(units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and hashes of all paragraphs (one entry per band)."""
    a, b, line = units.paragraphs()
    if not len(a):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = textgrams.combine(units.words.hashes)
    bounds = np.column_stack((a, b - textgrams.WORDS + 1)).ravel()
    padded = np.append(grams, np.uint64(0xFFFFFFFFFFFFFFFF))
    keys = []
    for band in range(BANDS):
        key = np.full(len(a), band, dtype=np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            values = (padded ^ _ADD[k]) * _MULTIPLY[k]
            key = textgrams.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(values, bounds)[0::2])
        keys.append(key)
    return np.concatenate(keys), np.tile(line.view(np.int64), BANDS)


def _rows(batch):
    """(doc ids, texts) of the rows that have both, in id order, each row once."""
    ids = batch.column("doc_id")
    batch = batch.filter(pc.and_(pc.is_valid(ids), pc.is_valid(batch.column("text"))))
    batch = batch.take(pc.sort_indices(batch.column("doc_id")))
    return batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), encode(batch.column("text"))


def _keys(batch):
    """Sentence rows (kind 0), band rows (kind 1) and anchors (kind 2, one that recurs twice) of a batch."""
    ids, texts = _rows(batch)
    for a, b in textgrams.slices(texts):
        u = Units(texts[a:b])
        doc, seq, key = ids[a:b][u.text], u.seq.astype(np.int32), u.hash
        again = np.zeros(len(doc), dtype=bool)  # a row that is there twice
        if len(doc) and len(np.unique(ids[a:b])) < b - a:
            _, at = np.unique(np.rec.fromarrays([doc, seq, key]), return_index=True)
            again[:] = True
            again[at] = False
        words = (u.end - u.first).astype(np.int32)
        bands, line = _bands(u)
        at = u.windows()
        anchor = u.anchors(at)
        head = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))[: len(at)]
        anchor, times = np.unique(anchor[head], return_counts=True)
        anchor = np.repeat(anchor, np.minimum(times, 2))
        rest = len(bands) + len(anchor)
        yield (np.concatenate((key[~again], bands, anchor)),
               {"kind": np.repeat(np.array([0, 1, 2], np.int8), [int((~again).sum()), len(bands), len(anchor)]),
                "doc": np.concatenate((doc[~again], line, np.zeros(len(anchor), np.int64))), "seq": np.concatenate((seq[~again], np.zeros(rest, np.int32))),
                "words": np.concatenate((words[~again], np.zeros(rest, np.int32)))})


def _repeats(key, part, shared, aside):
    """Rows of repeated keys: sentences after their first occurrence, all paragraphs of a band, an anchor once."""
    keep = part["kind"] != 2 if aside else repeated(key, shared)
    if not aside:
        order = np.lexsort((part["seq"], part["doc"], key))
        key, keep = key[order], keep[order]
        part = {c: x[order] for c, x in part.items()}
        head = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
        at = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
        first = (part["doc"] == part["doc"][at]) & (part["seq"] == part["seq"][at])
        keep &= ~(first & (part["kind"] == 0)) & (head | (part["kind"] != 2))
    at = np.flatnonzero(keep)
    for at in np.array_split(at, max(1, len(at) // 100_000)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[at]) for x in (part["kind"], key.view(np.int64), part["doc"], part["seq"], part["words"])], ["kind", "h", "doc", "seq", "words"])


def _windows(docs: DataFrame, bloom, buckets: int) -> DataFrame:
    """(doc, seq, h): windows that an earlier document has (seq -1), documents with a window of their own again (seq -2)."""

    def make(batch):
        for piece in pieces([batch]):
            ids, texts = _rows(piece)
            for a, b in textgrams.slices(texts):
                u = Units(texts[a:b])
                at = u.windows()
                at = at[bloom_has(bloom.value, u.anchors(at))]
                text = np.searchsorted(u.offsets, at, side="right") - 1
                doc, key = ids[a:b][text], u.window_hashes(at)
                own = np.unique(doc[_again(at, key, text)])
                order = np.lexsort((doc, key))
                doc, key = doc[order], key[order]
                new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))[: len(doc)]
                doc, key = doc[new], key[new]
                yield (np.concatenate((key, textgrams.mix(own.view(np.uint64)) ^ np.uint64(3))),
                       {"doc": np.concatenate((doc, own)), "own": np.repeat(np.array([False, True]), [len(doc), len(own)])})

    def finish(key, part, shared, aside):
        doc, own = part["doc"], part["own"]
        keep = np.ones(len(key), dtype=bool)
        if not aside:
            order = np.lexsort((doc, key))
            key, doc, own = key[order], doc[order], own[order]
            head = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
            keep = own | (doc != doc[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))])
        at = np.flatnonzero(keep)
        for at in np.array_split(at, max(1, len(at) // 100_000)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[at]), pa.array(np.where(own[at], -2, -1).astype(np.int32)), pa.array(np.where(own[at], 0, key.view(np.int64)[at]))], ["doc", "seq", "h"])

    return in_blocks(docs, make, {"doc": np.int64, "own": bool}, buckets, finish, "doc long, seq int, h long")


def _line_rows(docs: DataFrame, bloom) -> DataFrame:
    """Occurrences of the paragraphs whose hash passes the filter: (line, doc, seq, last, keys), first and last unit."""

    def run(batches):
        for batch in pieces(batches):
            ids, texts = _rows(batch)
            for s, e in textgrams.slices(texts):
                u = Units(texts[s:e])
                first, end, line = u.paragraphs()
                hit = bloom_has(bloom.value, line)
                first, end, line = first[hit], end[hit], line[hit]
                if not len(line):
                    continue
                grams = textgrams.combine(u.words.hashes)
                i, j = np.searchsorted(u.first, first), np.searchsorted(u.first, end) - 1
                new = np.zeros(len(line), dtype=bool)
                new[np.unique(line, return_index=True)[1]] = True
                keys = [np.unique(grams[a : b - textgrams.WORDS + 1]).tobytes() if n else None for a, b, n in zip(first.tolist(), end.tolist(), new.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(line.view(np.int64)), pa.array(ids[s:e][u.text[i]]), pa.array(u.seq[i].astype(np.int32)), pa.array(u.seq[j].astype(np.int32)), pa.array(keys, pa.binary())],
                    ["line", "doc", "seq", "last", "keys"])

    return docs.mapInArrow(run, "line long, doc long, seq int, last int, keys binary")


def _same(ka: bytes, kb: bytes) -> bool:
    a, b = np.frombuffer(ka, np.uint64), np.frombuffer(kb, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 4 * both >= 3 * (len(a) + len(b) - both)


def _verify(pairs: DataFrame, keys: DataFrame, tables: Tables, name: str) -> DataFrame:
    def run(batches):
        for batch in pieces(batches, "ka"):
            ok = pa.array([_same(x, y) for x, y in zip(batch.column("ka").to_pylist(), batch.column("kb").to_pylist(), strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    both = pairs.join(keys.select(F.col("line").alias("a"), F.col("keys").alias("ka")), "a").join(keys.select(F.col("line").alias("b"), F.col("keys").alias("kb")), "b")
    return tables.store(both.mapInArrow(run, "a long, b long"), f"{name}-links")


def removals(docs: DataFrame, tables: Tables) -> DataFrame:
    """(doc, units): per document the candidates (seq, h), where they reach MIN_WORDS words: sentences by
    number, windows (-1), a mark for windows of its own (-2), paragraphs to remove by their first sentence (-3 - seq)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # a block's rows are held in memory
    tables.fit(size)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BLOCK_BYTES)
    types = {"kind": np.int8, "doc": np.int64, "seq": np.int32, "words": np.int32}
    rows = in_blocks(docs, lambda b: (x for p in pieces([b]) for x in _keys(p)), types, buckets, _repeats, "kind byte, h long, doc long, seq int, words int")
    rows = tables.store(rows, "repeats")
    lists = tables.store(rows.where("kind = 1").select("h", "doc").distinct(), "bands")
    several = lists.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    lists = tables.store(lists.join(several, "h", "left_semi"), "lists")
    # equal paragraphs have one hash: one that occurs again is a cluster of its own
    copied = rows.where("kind = 1").groupBy("h", "doc").agg(F.count("*").alias("c")).where("c > 1").select("doc")
    wanted = spark.sparkContext.broadcast(bloom_build(lists.select("doc").union(copied).distinct(), "doc"))
    lines = tables.store(_line_rows(docs, wanted), "lines")
    keys = tables.store(lines.where("keys is not null").groupBy("line").agg(F.min("keys").alias("keys")), "keys")
    sets = keys.select(F.col("line").alias("doc"), "keys")
    clusters = linked_components(lists, lambda pairs, name: _verify(pairs, keys, tables, name), tables, sets=sets)
    member = lines.drop("keys").join(clusters.select(F.col("node").alias("line"), "component"), "line", "left")
    member = member.withColumn("component", F.coalesce("component", "line"))
    first = member.groupBy("component").agg(F.min(F.struct("doc", "seq", (-F.col("last")).alias("last"))).alias("kept"))
    near = member.join(first, "component").where("doc <> kept.doc or seq > -kept.last")  # a block and its lines do not remove each other
    near = near.select("doc", (F.lit(-3) - F.col("seq")).alias("seq"), F.col("line").alias("h"), F.lit(MIN_WORDS).alias("words"))
    exact = rows.where("kind = 0").select("doc", "seq", "h", "words")
    twice = spark.sparkContext.broadcast(bloom_build(rows.where("kind = 2"), "h"))
    windows = tables.store(_windows(docs, twice, buckets), "windows")
    every = exact.unionByName(near).unionByName(windows.withColumn("words", F.lit(MIN_WORDS))).distinct()
    out = every.groupBy("doc").agg(F.collect_list(F.struct("seq", "h")).alias("units"), F.sum("words").alias("words"))
    out = tables.store(out.where(F.col("words") >= MIN_WORDS).select("doc", "units"), "removals")
    tables.free("repeats", "bands", "lists", "lines", "keys", "windows")
    return out


SPACE = b" \t\r\n\v\f"


def _own(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes bound to the number of their text."""
    return textgrams.mix(hashes ^ textgrams.mix(text.astype(np.uint64)))


def _cut_words(u: Units, text: np.ndarray, seq: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of what is cut from a run of texts, given its candidates (text number, seq, h): runs
    of candidates of MIN_WORDS words or more, and near copies of paragraphs."""
    sentence = seq >= 0
    at, key = u.text_first[text[sentence]] + seq[sentence], h[sentence]
    there = at < u.text_first[text[sentence] + 1]
    at, key = at[there], key[there]
    unit = np.zeros(len(u.hash), dtype=bool)
    unit[at[u.hash[at] == key]] = True
    hit = np.repeat(unit, u.end - u.first)
    first = u.windows()
    key, owner = u.window_hashes(first), np.searchsorted(u.offsets, first, side="right") - 1
    late = np.isin(_own(owner, key), _own(text[seq == -1], h[seq == -1]))
    first = first[late | _again(first, key, owner)]
    depth = np.zeros(len(hit) + 1, dtype=np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, first + MIN_WORDS, -1)
    hit |= np.cumsum(depth)[:-1] > 0
    near = np.zeros(len(hit) + 1, dtype=np.int64)
    a, b, line = u.paragraphs()
    i = np.searchsorted(u.first, a)
    gone = seq <= -3
    place = lambda t, q, x: _own(t, x ^ textgrams.mix(q.astype(np.uint64)))
    found = np.isin(place(u.text[i], u.seq[i], line), place(text[gone], -3 - seq[gone], h[gone]))
    np.add.at(near, a[found], 1)
    np.add.at(near, b[found], -1)
    near = np.cumsum(near)[:-1] > 0

    def spans(mask):
        owner = np.repeat(np.arange(len(u.offsets) - 1), np.diff(u.offsets))
        on = np.flatnonzero(mask)
        if not len(on):
            return on, on
        new = np.ones(len(on), dtype=bool)
        new[1:] = (np.diff(on) > 1) | (owner[on[1:]] != owner[on[:-1]])
        head = np.flatnonzero(new)
        return on[head], on[np.append(head[1:], len(on)) - 1] + 1

    hit |= near
    i, j = spans(hit)
    short = j - i < MIN_WORDS
    keep = np.zeros(len(hit) + 1, dtype=np.int64)
    np.add.at(keep, i[~short], 1)
    np.add.at(keep, j[~short], -1)
    return spans((np.cumsum(keep)[:-1] > 0) | near)


def cut(texts: list[bytes], text: np.ndarray, seq: np.ndarray, h: np.ndarray) -> list[tuple[str, list[str], int]]:
    """Per text: what is left of it, what was cut out, its words."""
    u = Units(texts)
    first, end = _cut_words(u, text, seq, h)
    owner = np.searchsorted(u.offsets, first, side="right") - 1
    base = u.words.offsets
    starts, ends = u.words.starts[first] - base[owner], u.words.ends[end - 1] - base[owner]
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k, raw in enumerate(texts):
        kept, gone, words, position = [], [], 0, 0
        for i in range(at[k], at[k + 1]):
            a, b = int(starts[i]), int(ends[i])
            gone.append(raw[a:b].decode())
            words += int(end[i] - first[i])
            kept.append(raw[position:a])
            position = b
            while position < len(raw) and raw[position] in SPACE:
                position += 1
        kept.append(raw[position:])
        whole = b"".join(kept)
        out.append(((whole.rstrip(SPACE) if gone and position == len(raw) else whole).decode(), gone, words))
    return out


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with all its columns, the text without repeated passages, and
    ``removed`` (the passages cut out, array of strings) and ``removed_words`` (long).

    Columns of ``docs`` named like the two new ones are replaced.  Rows with a null id or text and
    empty texts come back as they are.  Among equal passages the one with the smallest (doc_id,
    position) stays; rows that repeat a doc_id count as one document.  No row is dropped: a text
    that is a copy throughout becomes empty.
    """
    spark = docs.sparkSession
    base = tidy(docs, id_col, text_col)
    tables = Tables(spark, "paragraph-dedup")
    found = removals(base, tables)
    wanted = spark.sparkContext.broadcast(bloom_build(found, "doc"))
    docs = docs.drop("removed", "removed_words")
    names = docs.columns

    new = T.StructType([*docs.schema.fields, T.StructField("removed", T.ArrayType(T.StringType())), T.StructField("removed_words", T.LongType())])

    def clean(batches):
        for batch in pieces(batches, text_col, textgrams.SLICE_BYTES):
            column, units = batch.column(text_col), batch.column("__units")
            sizes = pc.fill_null(pc.list_value_length(units), 0).to_numpy(zero_copy_only=False)
            flat = units.flatten()
            seq, h = (flat.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            asked = (sizes > 0) & (pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy(zero_copy_only=False) > 0)
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            number = np.cumsum(asked) - 1
            of = asked[rows]
            texts, gone, words = column.to_pylist(), [[]] * batch.num_rows, [0] * batch.num_rows
            if asked.any():
                at = np.flatnonzero(asked).tolist()
                done = cut([texts[i].encode() for i in at], number[rows[of]], seq[of].astype(np.int64), h[of].astype(np.int64).view(np.uint64))
                for i, (left, out, n) in zip(at, done, strict=True):
                    texts[i], gone[i], words[i] = left, out, n
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.list_(pa.string())), pa.array(words, pa.int64())], [*names, "removed", "removed_words"])

    marked = docs.withColumn("__maybe", maybe_in(wanted, F.col(f"`{id_col}`")))
    same = marked.where("not __maybe").drop("__maybe").withColumns({"removed": F.array().cast("array<string>"), "removed_words": F.lit(0).cast("long")})
    changed = marked.where("__maybe").drop("__maybe")
    changed = changed.join(found.select(F.col("doc").alias("__doc"), F.col("units").alias("__units")), F.col(id_col) == F.col("__doc"), "left").drop("__doc")
    return same.unionByName(tables.fitted(changed.mapInArrow(clean, new)))
