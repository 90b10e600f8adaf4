"""Operator 10: tiles against a naive greedy tiling, planted items, edges."""

import random
import re

import numpy as np
import pytest

from spanwise.llm import textgrams
from spanwise.llm.decontaminate import MIN_MATCH, contaminated, tiles


def naive(item, text):
    """Greedy string tiling by looking at every pair of positions, again for each tile."""
    used_i, used_t, out = set(), set(), 0
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and i + k not in used_i and j + k not in used_t:
                    k += 1
                if k >= MIN_MATCH and (best is None or k > best[0]):
                    best = (k, i, j)
        if best is None:
            return out
        k, i, j = best
        used_i |= set(range(i, i + k))
        used_t |= set(range(j, j + k))
        out += k


@pytest.mark.parametrize("seed", range(40))
def test_tiles_against_naive_tiling(seed):
    rng = random.Random(seed)
    item = [rng.randrange(rng.choice([2, 8, 200])) for _ in range(rng.randrange(0, 30))]
    text = [rng.randrange(200) for _ in range(rng.randrange(0, 20))]
    for _ in range(rng.randrange(4)):
        a = rng.randrange(len(item) + 1)
        text[rng.randrange(len(text) + 1) : 0] = item[a : a + rng.randrange(15)]
    a, b = np.array(item, dtype=np.uint64), np.array(text, dtype=np.uint64)
    found = tiles(a, b, textgrams.combine(a), textgrams.combine(b))
    covered_i, covered_t = [], []
    for i, j, s in found:
        assert s >= MIN_MATCH and item[i : i + s] == text[j : j + s]
        covered_i += range(i, i + s)
        covered_t += range(j, j + s)
    assert len(covered_i) == len(set(covered_i)) and len(covered_t) == len(set(covered_t))
    assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
    if len(set(item)) > 8:  # no ties between equal runs
        assert len(covered_i) == naive(item, text)


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_planted_items(spark):
    rng = random.Random(5)
    items = [(i, words(rng, 40)) for i in range(20)]
    rows = [(100 + k, " ".join(words(rng, 80))) for k in range(40)]
    whole = items[3][1]
    moved = items[4][1][30:] + words(rng, 5) + items[4][1][10:30] + words(rng, 3) + items[4][1][:10]
    rows += [(1, " ".join(words(rng, 30) + whole + words(rng, 30))), (2, " ".join(moved)), (3, ("-".join(whole) + "!").upper()),
             (4, " ".join(items[5][1][:12] + words(rng, 50))), (5, " ".join(items[6][1] + items[7][1])), (6, " ".join(items[8][1][:20]))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, item_id string, words int")
    bench = spark.createDataFrame([(i, " ".join(w), 9) for i, w in items], "item_id long, text string, doc_id int")
    got = {r.doc_id: (r.n_items, r.coverage, list(r.items)) for r in contaminated(docs, bench).collect()}
    assert got == {1: (1, 1.0, [3]), 2: (1, 1.0, [4]), 3: (1, 1.0, [3]), 5: (2, 1.0, [6, 7]), 6: (1, 0.5, [8])}


def test_edges(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, None), (3, ""), (4, "one two"), (None, "k l m n o p"), (5, "z " * 40)],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x a b c d e f g h y"), (3, "x a b c d e f g h y"), (None, "a b c d e f g h"),
                                  (4, "one two"), (5, "k l m n o p"), (6, "z " * 20_000), (7, "q " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.coverage, list(r.items)) for r in contaminated(docs, bench).collect()}
    assert got == {3: (1, 1.0, [1]), 6: (1, 1.0, [5])}
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_whole_items_in_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    want = {r.doc_id for r in docs.collect() if any(x in plain(r.text) for x in items.values())}
    got = {r.doc_id for r in contaminated(docs, bench).collect()}
    assert want and want <= got
    assert len(got - want) <= 2
