"""Operator 5 against all pairs."""

import numpy as np
import pytest

from spanwise.llm.pivot_index import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, rep int"


def brute(rows):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
          if i is not None and v is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)]
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, v) in enumerate(ok):
        for j, w in ok[:a]:
            if len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.95:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


def found(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    out = near_duplicates(df).collect()
    assert len(out) == len(rows)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}


@pytest.mark.parametrize("seed", range(1))
def test_recall_and_precision(spark, seed):
    rng = np.random.default_rng(seed)
    points = [rng.normal(size=24) for _ in range(250)]
    points += [points[k % 40] + rng.normal(size=24) * 0.03 for k in range(120)]  # near copies
    points += [points[0] + rng.normal(size=24) * 0.02 for _ in range(300)]  # a crowd
    points += [points[7] * 3.0] * 20 + [points[5]] * 30
    rows = [(int(i) * 2 + 1, [float(x) for x in points[i].astype(np.float32)]) for i in rng.permutation(len(points))]
    got, want = found(spark, rows), brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)  # nothing below the threshold
    total = sum(w[0] for w in want.values())
    assert sum(g[0] for g in got.values()) >= 0.99 * total
    assert sum(got[i][1] != want[i][1] for i in want) <= 0.01 * len(want)


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
            (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e-30, 1e-31]), (12, [3e37, 1e36]), (13, [nan, 1.0])]
    assert found(spark, rows) == brute(rows)


def test_repeats_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (5, 2, 1, False), (None, 0, None, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_whole_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = dict(zip([i for i, _ in rows], ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist(), strict=True))
    got = {r.vec_id: r.n_links for r in near_duplicates(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.9 * sum(want.values())
