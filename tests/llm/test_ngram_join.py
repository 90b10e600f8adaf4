"""Operator 8 against sets of word tuples."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanwise.llm import ngram_join, textgrams
from spanwise.llm.ngram_join import jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = {}
    for i, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in at[g] if j > i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, doc string, component string")
    out = jaccard_components(df).collect()
    assert len(out) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


def near_copies(seed, base_words, copies, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(300)}" for _ in range(base_words)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = near_copies(seed, 60, 60, 4) + near_copies(seed + 50, 12, 15, 1)  # a dense group and short texts
    line = "a line that very many documents share word for word."
    texts += [line + " " + " ".join(f"r{rng.randrange(10**5)}" for _ in range(rng.randrange(3, 40))) for _ in range(60)]
    texts += [rng.choice(texts) for _ in range(20)] + [" ".join(f"q{rng.randrange(9)}" for _ in range(rng.randrange(9))) for _ in range(30)]
    rng.shuffle(texts)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    assert found(spark, rows) == brute(rows)


def test_nulls_short_texts_ties_and_long_words(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (7, "É a b c d"), (8, "é a b c d"),
            (9, "x" * 50_000), (10, "x" * 50_000), (11, "w " * 30_000), (12, "w w w w w"), (13, "a b c d e"), (14, "a b c d e"),
            (-5, "one two"), (2**40, "one two three")]
    assert found(spark, rows) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert jaccard_components(df.limit(0)).count() == 0


def test_hashing_is_the_same_in_any_slice(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab c D é \n ẞ zz".split(" ")) for _ in range(rng.randrange(30))).encode() for _ in range(200)]
    whole = [s.tolist() for s in textgrams.shingle_sets(texts)]
    assert [len(s) for s in whole] == [len(shingles(t.decode())) for t in texts]
    monkeypatch.setattr(textgrams, "SLICE_BYTES", 50)
    assert [s.tolist() for s in textgrams.shingle_sets(texts)] == whole
    assert np.array_equal(textgrams.word_hashes([b"Ab", b"aB c"])[0], textgrams.word_hashes([b"x ab ab c"])[0][1:])


@pytest.mark.parametrize("columns", [1, 3, 1 << 15])
def test_product_against_sets(monkeypatch, columns):
    monkeypatch.setattr(ngram_join, "COLUMNS", columns)
    rng = random.Random(columns)
    sets = []
    for _ in range(25):
        base = rng.sample(range(10**6), rng.randrange(1, 25))
        sets += [sorted({x if rng.random() < 0.93 else rng.randrange(10**6) for x in base}) for _ in range(4)]
    pairs = [(4 * g + i, 4 * g + j) for g in range(25) for i in range(4) for j in range(4)] + [tuple(rng.sample(range(100), 2)) for _ in range(200)]
    packed = [np.array(s, dtype=np.uint64) for s in sets]

    def ask(cut):
        na, nb = (np.array([len(sets[p[k]]) for p in pairs]) for k in (0, 1))
        ka, kb = (pa.array([packed[p[k]][: cut(len(packed[p[k]]))].tobytes() for p in pairs], pa.binary()) for k in (0, 1))
        return ngram_join.reaches(na, ka, nb, kb).tolist()

    linked = [100 * len({*sets[a]} & {*sets[b]}) >= 75 * len({*sets[a]} | {*sets[b]}) for a, b in pairs]
    assert 50 < sum(linked) < len(linked) - 50
    assert ask(lambda n: n) == linked
    may = ask(ngram_join._prefix_len)
    assert all(m for m, x in zip(may, linked, strict=True) if x) and not all(may)


def test_a_list_that_most_documents_are_in(spark):
    rng = random.Random(8)
    crowd = near_copies(8, 40, 700, 3)  # far edits fall out, so the list holds several components
    texts = crowd + [c + " " + " ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 30))) for c in crowd[:150]]
    rows = list(enumerate(texts))
    assert found(spark, rows) == brute(rows)
