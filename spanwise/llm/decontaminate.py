"""Operator 10, benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits.  Documents and benchmark items are joined on
shared seeds (runs of MIN_MATCH words); a fixed-size Bloom filter of the benchmark's seeds keeps
documents without any seed out of that join, whatever the benchmark's size.  For every pair that
shares enough seeds, running Karp-Rabin matches are tiled greedily: the longest match whose words are
all unmarked is marked in both texts, again and again, down to MIN_MATCH words.  An item whose tiled
words reach COVERAGE of its words contaminates the document; tiles may come in any order, so
reordered passages count.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm import textgrams
from spanwise.llm.common import Tables, bloom_build, bloom_has, pieces, tidy

MIN_MATCH = textgrams.WORDS
COVERAGE = 0.5


def _words(batch, column: str = "text"):
    """Per row its word hashes and seed hashes (run i starts at word i)."""
    texts = [x.lower().encode() if x else b"" for x in batch.column(column).to_pylist()]
    for a, b in textgrams.slices(texts):
        w = textgrams.Words(texts[a:b], punctuation=False)
        grams = textgrams.combine(w.hashes)
        at = 0
        for c in w.counts.tolist():
            yield w.hashes[at : at + c], grams[at : at + max(0, c - MIN_MATCH + 1)]
            at += c


def tiles(item: np.ndarray, text: np.ndarray, item_seeds: np.ndarray, text_seeds: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, words), longest first; ties: smaller starts."""
    at = np.flatnonzero(np.isin(text_seeds, item_seeds))
    order = np.argsort(item_seeds, kind="stable")
    lo = np.searchsorted(item_seeds[order], text_seeds[at], side="left")
    hi = np.searchsorted(item_seeds[order], text_seeds[at], side="right")
    n = hi - lo
    j = np.repeat(at, n)
    i = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    if not len(i):
        return []
    new = np.concatenate(([True], (np.diff(i) != 1) | (np.diff(j) != 1)))  # maximal runs on a diagonal
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(i))) + MIN_MATCH - 1
    heap = [(-s, a, b) for s, a, b in zip(size.tolist(), i[start].tolist(), j[start].tolist(), strict=True)]
    heapq.heapify(heap)
    in_item, in_text = np.zeros(len(item), dtype=bool), np.zeros(len(text), dtype=bool)
    out = []
    while heap:
        s, a, b = heapq.heappop(heap)
        s = -s
        free = ~(in_item[a : a + s] | in_text[b : b + s])
        if free.all():
            in_item[a : a + s] = in_text[b : b + s] = True
            out.append((a, b, s))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            if y - x >= MIN_MATCH:
                heapq.heappush(heap, (x - y, a + x, b + x))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, tables: Tables, least: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) of the pairs whose seeds allow coverage ``least``."""
    sc = docs.sparkSession.sparkContext

    def of_items(batches):
        for batch in pieces(batches):
            rows = list(_words(batch))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([w.tobytes() for w, _ in rows], pa.binary()), pa.array([s.view(np.int64) for _, s in rows], pa.list_(pa.int64()))], ["item_id", "words", "seeds"])

    items = tables.store(benchmark.where("item_id is not null").dropDuplicates().mapInArrow(of_items, "item_id long, words binary, seeds array<long>"), "items")
    seeds = items.select("item_id", F.octet_length("words").alias("size"), F.explode("seeds").alias("h"))
    seeds = seeds.groupBy("item_id", "size", "h").agg(F.count("*").alias("m"))
    wanted = sc.broadcast(bloom_build(seeds, "h"))

    def of_docs(batches):
        for batch in pieces(batches):
            ids, rows = [], []
            for doc, (w, s) in zip(batch.column("doc_id").to_pylist(), _words(batch), strict=True):
                if doc is not None and len(s):
                    hit = bloom_has(wanted.value, s)
                    if hit.any():
                        ids.append(doc)
                        rows.append((w.tobytes(), np.unique(s[hit]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([w for w, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.list_(pa.int64()))], ["doc_id", "words", "seeds"])

    hits = tables.store(docs.mapInArrow(of_docs, "doc_id long, words binary, seeds array<long>"), "hits")
    pairs = hits.select("doc_id", F.explode("seeds").alias("h")).join(seeds, "h").groupBy("doc_id", "item_id", "size").agg(F.sum("m").alias("c"))
    # words of the item (8 bytes each in size) that tiles can cover: MIN_MATCH for each shared seed
    pairs = pairs.where(F.col("c") * MIN_MATCH * 8 >= F.col("size") * F.lit(least)).select("doc_id", "item_id")

    def tile(batches):
        for batch in batches:
            out = {"doc_id": batch.column("doc_id"), "item_id": batch.column("item_id"), "coverage": [], "tiles": []}
            for a, b in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist(), strict=True):
                item, text = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                found = tiles(item, text, textgrams.combine(item), textgrams.combine(text))
                out["coverage"].append(sum(s for _, _, s in found) / len(item))
                out["tiles"].append([{"item_start": i, "doc_start": j, "words": s} for i, j, s in found])
            kind = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([out["doc_id"], out["item_id"], pa.array(out["coverage"], pa.float64()), pa.array(out["tiles"], kind)], ["doc_id", "item_id", "coverage", "tiles"])

    both = pairs.join(items.select("item_id", F.col("words").alias("item")), "item_id").join(hits.select("doc_id", "words"), "doc_id")
    schema = "doc_id long, item_id long, coverage double, tiles array<struct<item_start:int,doc_start:int,words:int>>"
    return tables.store(both.select("doc_id", "item_id", "item", "words").mapInArrow(tile, schema), "matches")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, n_items, coverage, items): the documents that an item contaminates, with the number
    of such items, the best coverage and the ids, ascending.

    Null ids and texts, empty texts and texts or items of fewer than MIN_MATCH words match nothing.
    Rows that repeat a doc_id or item_id count as one, with their best coverage.  Other columns are
    ignored; empty tables give an empty result.
    """
    tables = Tables(docs.sparkSession, "decontaminate")
    bench = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    found = matches(tidy(docs, id_col, text_col), bench, tables, coverage)
    best = found.where(F.col("coverage") >= coverage).groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))
    return best.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("coverage").alias("coverage"), F.sort_array(F.collect_list("item_id")).alias("items"))
