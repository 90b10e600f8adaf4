"""Operator 8, n-gram Jaccard join: blocked sparse product of document x n-gram incidence.

Two documents link when ``100 * |A & B| >= 75 * |A | B|`` over their sets of distinct 5-word
shingles.  Equal sets collapse into classes first.  All sets are ordered by one global order, rare
n-grams first (by a fixed-size count sketch; it only steers cost, links are exact whatever it says).  Size-derived bounds then discard pairs without losing a link:

* *prefix*: linked sets share an n-gram among the first ``n - ceil(0.75 n) + 1`` of each;
* *position*: with ``a = ceil(3 (n1 + n2) / 7)`` shared n-grams needed, the first shared one is at a
  position of at most ``n - a`` in either set;
* *accumulated overlap*: n-grams shared so far plus what the rest can still add must reach ``a``.

Prefix incidence is shuffled in n-gram blocks (packed columns).  A task sends an n-gram at most once
per batch into its block, so a block's list is bounded by batches, not by documents; blocks drop
n-grams of a single document.  Lists are then compared in two passes: every member with the list's
head, and after connecting those links, only members outside the list's main component with
members of other components.  So a large group of near copies costs its size, not its square, and
every pair that could join two components is still verified on whole sets.

Overlaps are entries of the sparse product of the incidence matrix with its transpose (``reaches``).  Only
entries that the lists name are computed, as all entries of a group would be all its pairs.  A task takes
a block of them and multiplies it in blocks of n-grams, in the global order: counts accumulate from
block to block and a pair leaves the product as soon as the accumulated overlap rules it out.  Rows are the
prefixes first, the whole sets of the survivors then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm import textgrams
from spanwise.llm.blocks import in_blocks, repeated
from spanwise.llm.candidates import linked_components
from spanwise.llm.common import Tables, bloom_build, bloom_has, encode, pieces, tidy

SKETCH_BITS = 22  # slots of the rarity estimate: a table of four megabytes reaches the executors
LEAST_LOCAL = 4  # a task reports the slots that it met this often
LEVEL_SHIFT = np.uint64(58)
GRAM_BYTES = 8  # of text for each n-gram: a word and its space, about
COLUMNS = 1 << 15  # n-grams in a block of the product
PRODUCT_BYTES = 2 << 20  # of rows multiplied at a time
NUM, DEN = 75, 100  # Jaccard threshold as a fraction


def _needed(total):
    """Least shared n-grams of two linked sets whose sizes add up to ``total``."""
    return -(-NUM * total // (NUM + DEN))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def rarity(docs: DataFrame) -> np.ndarray:
    """Level (log2 of a count) per sketch slot, from all shingles of all texts.

    A task counts its shingles in a local table and reports only slots that it met LEAST_LOCAL times
    or more, so shingles that are rare everywhere leave no noise behind, however large the corpus.
    One long per slot at most (SKETCH_BITS) reaches the driver.
    """
    size = 1 << SKETCH_BITS

    def count(batches):
        total = np.zeros(size, dtype=np.int32)
        for batch in pieces(batches):
            texts = encode(batch.column("text"))
            for a, b in textgrams.slices(texts):
                grams = textgrams.combine(textgrams.word_hashes(texts[a:b])[0])
                slots, n = np.unique(_slot(grams), return_counts=True)
                total[slots] += n.astype(np.int32)
        at = np.flatnonzero(total >= LEAST_LOCAL)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], ["slot", "n"])

    sums = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    levels = np.zeros(size, dtype=np.uint8)
    table = sums.select("slot", F.floor(F.log2("n")).cast("byte").alias("level")).toArrow()
    levels[table["slot"].to_numpy()] = np.minimum(table["level"].to_numpy(), 31)
    return levels


def _ordered(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Sorted keys of a set: level in the upper bits, hash in the other 58."""
    return np.sort((levels[_slot(h)].astype(np.uint64) << LEVEL_SHIFT) | (h >> np.uint64(6)))


def _prefix_len(n: int) -> int:
    return n - (-(-NUM * n // DEN)) + 1 if n else 0


def shingled(docs: DataFrame, levels) -> DataFrame:
    """(doc_id, n, f1, f2, prefix) of every row; f1, f2: fingerprint of the whole set."""

    def run(batches):
        for batch in pieces(batches):
            n, f1, f2, prefix = [], [], [], []
            for h in textgrams.shingle_sets(encode(batch.column("text"))):
                n.append(len(h))
                f1.append(int(np.sum(textgrams.mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).view(np.int64)))
                f2.append(int(np.sum(textgrams.mix(h * np.uint64(0xDA942042E4DD58B5)), dtype=np.uint64).view(np.int64)))
                prefix.append(_ordered(h, levels.value)[: _prefix_len(len(h))].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(prefix, pa.binary())],
                ["doc_id", "n", "f1", "f2", "prefix"])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, prefix binary")


def _flat(batch):
    """Prefix n-grams of a batch of sets as columns: key, doc, n, position."""
    blobs = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("prefix").to_pylist()]
    lens = np.array([len(x) for x in blobs], dtype=np.int64)
    key = np.concatenate([np.empty(0, np.uint64), *blobs])
    doc = np.repeat(batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64), lens)
    n = np.repeat(batch.column("n").to_numpy(zero_copy_only=False).astype(np.int32), lens)
    pos = np.arange(len(key)) - np.repeat(np.cumsum(lens) - lens, lens)
    return key, doc, n, pos.astype(np.int32)


def postings(sets: DataFrame, buckets: int) -> DataFrame:
    """(h, doc, n, pos): prefix incidence without the n-grams that only one set has there."""

    def make(batch):
        for part in pieces([batch], "prefix"):
            key, doc, n, pos = _flat(part)
            yield key, {"doc": doc, "n": n, "pos": pos}

    def finish(key, part, shared, aside):
        at = np.arange(len(key)) if aside else np.flatnonzero(repeated(key, shared))
        for at in np.array_split(at, max(1, len(at) // 100_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (key.view(np.int64), part["doc"], part["n"], part["pos"])], ["h", "doc", "n", "pos"])

    types = {"doc": np.int64, "n": np.int32, "pos": np.int32}
    return in_blocks(sets.select("doc", "n", "prefix"), make, types, buckets, finish, "h long, doc long, n int, pos int")


def _near(a: str, b: str):
    """Position bound of a pair of postings (see the module's docstring)."""
    need = F.ceil((F.col(f"{a}.n") + F.col(f"{b}.n")) * NUM / F.lit(NUM + DEN))
    return (F.col(f"{a}.n") - F.col(f"{a}.pos") >= need) & (F.col(f"{b}.n") - F.col(f"{b}.pos") >= need)


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a column of packed sets, side by side, and the number of each row's keys."""
    rows = [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]
    return np.concatenate([np.empty(0, np.uint64), *rows]), np.array([len(x) for x in rows], dtype=np.int64)


def reaches(na: np.ndarray, ka: pa.Array, nb: np.ndarray, kb: pa.Array) -> np.ndarray:
    """Which pairs may reach the overlap that a link needs, by the keys at hand.

    ``ka``, ``kb``: packed ascending first keys of sets of ``na`` and ``nb`` keys; if all keys are there, the
    answer is exact.  Rows of the left matrix that several pairs name are held once.
    """
    need = _needed(na + nb)
    alive = np.minimum(na, nb) >= need
    coded = ka.dictionary_encode()
    row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    left, sizes = _rows(coded.dictionary)
    right, lens = _rows(kb)
    if not len(left) or not len(right):
        return alive & (need == 0)
    start, end = np.cumsum(sizes) - sizes, np.cumsum(sizes)
    pair = np.repeat(np.arange(len(lens)), lens)
    limit = np.minimum(left[np.maximum(end - 1, 0)][row], right[np.maximum(np.cumsum(lens) - 1, 0)])  # both sides are known up to here
    names, column = np.unique(left, return_inverse=True)
    width = len(names)
    cells = np.repeat(np.arange(len(sizes)), sizes) * width + column  # the left matrix, ascending
    inside = right <= limit[pair]
    at, pair = np.searchsorted(names, right[inside]), pair[inside]
    shared = (at < width) & (names[np.minimum(at, width - 1)] == right[inside])
    top = np.searchsorted(names, limit, side="right")

    def seen(upto: np.ndarray) -> np.ndarray:  # left keys in columns before ``upto``
        return np.searchsorted(cells, row * width + upto) - start[row]

    both, passed = np.zeros(len(na), dtype=np.int64), np.zeros(len(na), dtype=np.int64)
    block = at // COLUMNS  # right keys between two names go with the later one
    order = np.argsort(block, kind="stable")
    edges = np.searchsorted(block[order], np.arange(width // COLUMNS + 2))
    for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        now = order[x:y]
        passed += np.bincount(pair[now], minlength=len(na))
        now = now[shared[now] & alive[pair[now]]]
        cell = row[pair[now]] * width + at[now]
        hit = cells[np.minimum(np.searchsorted(cells, cell), len(cells) - 1)] == cell
        both += np.bincount(pair[now[hit]], minlength=len(na))
        alive &= both + np.minimum(na - seen(np.minimum(top, (k + 1) * COLUMNS)), nb - passed) >= need
    return alive


def _paired(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose overlap may reach what a link needs (``reaches``)."""

    def run(batches):
        for batch in pieces(batches, "ka", PRODUCT_BYTES):
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("na", "nb"))
            ok = pa.array(reaches(na, batch.column("ka"), nb, batch.column("kb")))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])

    left = sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    right = sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    return pairs.join(left, "a").join(right, "b").select("a", "na", "ka", "b", "nb", "kb").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, levels, tables: Tables, name: str) -> DataFrame:
    """Exact links among candidate pairs: prefix overlap first, whole sets of the survivors then."""
    close = tables.store(_paired(pairs, sets.withColumnRenamed("prefix", "keys")).distinct(), f"{name}-close")
    ids = close.select(F.col("a").alias("doc")).union(close.select("b"))
    wanted = docs.sparkSession.sparkContext.broadcast(bloom_build(ids, "doc"))

    def whole(batches):
        for batch in pieces(batches):
            ids = batch.column("doc_id")
            hit = bloom_has(wanted.value, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).view(np.uint64))
            batch = batch.filter(pc.and_(pa.array(hit), pc.is_valid(ids)))
            if not batch.num_rows:
                continue
            hs = list(textgrams.shingle_sets(encode(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(h) for h in hs], pa.int64()), pa.array([_ordered(h, levels.value).tobytes() for h in hs], pa.binary())],
                ["doc", "n", "keys"])

    full = docs.mapInArrow(whole, "doc long, n long, keys binary")
    full = tables.store(full.join(ids.distinct(), "doc", "left_semi"), f"{name}-full")
    links = tables.store(_paired(close, full).distinct(), f"{name}-links")
    tables.free(f"{name}-full", f"{name}-close")
    return links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Null or empty texts and texts without words have no shingles and are components of their own.
    Rows with equal sets are linked.  Rows that repeat a doc_id are separate rows of one document id;
    a null doc_id is kept with a null component and links nothing.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = tidy(docs, id_col, text_col)
    tables = Tables(spark, "ngram-join")
    levels = spark.sparkContext.broadcast(rarity(docs))
    own = tables.store(shingled(docs, levels), "sets")
    tables.fit(GRAM_BYTES * (own.agg(F.sum("n")).first()[0] or 0))
    key = ["n", "f1", "f2"]
    classes = tables.store(own.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("doc")), "classes")
    one = own.join(classes.select(*key, F.col("doc").alias("doc_id"), "doc"), [*key, "doc_id"])
    sets = tables.store(one.select("doc", "n", "prefix"), "reps")
    total = sets.agg(F.sum("n")).first()[0] or 0  # a quarter of these n-grams go into the blocks
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (8 << 20))
    lists = tables.store(postings(sets, buckets), "postings")

    found = linked_components(lists, lambda pairs, name: _verify(pairs, sets, docs, levels, tables, name), tables, _near)
    tables.free("postings", "reps")

    of_class = classes.join(found.withColumnRenamed("node", "doc"), "doc", "left").select(*key, F.coalesce("component", "doc").alias("component"))
    out = tables.fitted(own.select("doc_id", *key).join(of_class, key, "left"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
