"""Whitening: FEAST against a dense eigen-solver, the query against numpy on whole tables."""

import numpy as np
import pytest

from spanwise.llm import whitening as w


def random_covariance(rng, case):
    d, n = int(rng.integers(1, 40)), int(rng.integers(2, 200))
    x = rng.standard_normal((n, d)) * np.exp(rng.standard_normal(d) * rng.choice([0, 0.1, 1, 4]))
    if case % 5 == 0:
        x[:, 0] = x[:, -1]  # dependent dimensions
    if case % 7 == 0:
        x = np.round(x[:, :1]) * np.ones((1, d))  # rank one
    c = x - x.mean(axis=0)
    if case % 11 == 0:
        return np.eye(d) * 3.0  # all eigenvalues equal
    if case % 13 == 0:
        return np.diag(np.concatenate((np.full(min(d, 6), 5.0), np.full(max(d - 6, 0), 2.0))))  # ties across the cut
    return c.T @ c / n


def test_leading_against_dense_solver():
    rng = np.random.default_rng(1)
    for case in range(120):
        v = random_covariance(rng, case)
        values, vectors = w.leading(v, 4)
        want = np.linalg.eigvalsh(v)[::-1]
        assert len(values) == min(4, int((want > 8 * len(v) * np.finfo(float).eps * np.trace(v)).sum()))
        if len(values):
            assert np.max(np.abs(values - want[: len(values)])) <= 1e-13 * want[0]
            assert np.max(np.linalg.norm(v @ vectors - vectors * values, axis=0)) <= 1e-12 * want[0]
            assert np.max(np.abs(vectors.T @ vectors - np.eye(len(values)))) <= 1e-13


def test_inertia_counts():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a = rng.standard_normal((12, 12))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        t = w.tridiagonal(a)
        for sigma in np.concatenate(((values[1:] + values[:-1]) / 2, [values[0] - 1, values[-1] + 1])):
            assert w.count_above(*t, sigma) == (values > sigma).sum()


def test_feast_finds_an_inner_interval():
    v = np.diag([1.0, 2.0, 2.5, 4.0, 9.0])
    values, vectors = w.feast(v, 1.5, 3.0, 2)
    assert np.allclose(values, [2.5, 2.0], atol=1e-14) and np.allclose(np.abs(vectors), np.eye(5)[:, [2, 1]], atol=1e-12)
    with pytest.raises(ArithmeticError):
        w.feast(v, 1.5, 3.0, 3)  # a wrong count is noticed


def brute(rows, k=4):
    """vec_id -> (n, deviation, [(whitened up to sign, explained)]) with exact integers and a dense solver."""
    good = [(i, [int(np.floor(256 * float(c))) for c in e]) for i, e in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=object)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    mean = np.array([s / n for s in sums])
    c = fit.astype(float) - mean
    v = c.T @ c / n
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    out = []
    for i, x in good:
        out.append((i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), (np.array(x, dtype=float) - mean) @ vecs / np.sqrt(values), values / np.trace(v)))
    return out


def compare(got, want, k=4):
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    signs = None
    assert len(got) == k * len(want)
    for i, n, dev, white, explained in want:
        rows = [by[i, dev][c + 1][0] for c in range(k)]
        mine = np.array([r.whitened for r in rows])
        if signs is None or not signs.all():
            signs = np.sign(mine * white) if signs is None else np.where(signs == 0, np.sign(mine * white), signs)
        assert {r.n for r in rows} == {n}
        assert np.allclose(mine, white * signs, rtol=1e-9, atol=1e-9)
        assert np.allclose([r.explained for r in rows], explained, rtol=1e-10)
        assert all(r.identity_error < 1e-9 for r in rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_whole_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    compare(w.whitened(df).collect(), brute([(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]))


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(6) * [3, 2, 1.5, 1.2, 0.5, 0.1]]) for i in range(200)]
    copies = [(1000 + i, rows[3][1]) for i in range(300)] + [(3, rows[3][1]), (None, rows[5][1]), (3, rows[9][1])]
    bad = [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [1e300] * 6), (2005, []), (2006, [1.0, 2.0])]
    rows += [(500, [-0.0] * 6), (501, [-0.001] * 6)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows + copies + bad], "vec_id long, embedding array<double>, x string, n int")
    compare(w.whitened(df).collect(), brute(rows + copies))


@pytest.mark.parametrize(("rows", "ranks"), [([(1, [1.0, 2.0, 3.0])], 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 0), ([(1, [1.0, 2.0, 0.0, 0.0, 5.0]), (2, [2.0, 2.0, 0.0, 0.0, 5.0])], 1)])
def test_fewer_components_than_asked(spark, rows, ranks):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = w.whitened(df).collect()
    d = len(rows[0][1])
    assert len(got) == len(rows) * min(4, d)
    for r in got:
        assert (r.whitened is not None) == (r.component <= ranks)
        assert r.explained == pytest.approx(1.0 if ranks and r.component == 1 else 0.0)
    assert ranks == 0 or sorted(r.whitened for r in got if r.component == 1) == pytest.approx([-1.0, 1.0])


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id int, embedding array<float>")
    out = w.whitened(df)
    assert out.collect() == [] and out.schema["vec_id"].dataType.simpleString() == "int"


def test_exact_deviation_beyond_doubles():
    x = np.array([[2**40, -5], [3, 2**33 + 1]], dtype=np.int64)
    sums = [2**40 + 3, 2**33 - 4]
    want = [sum((2 * int(a) - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    assert w.deviations(x, 2, sums) == [t if t < 1 << 63 else None for t in want]
    assert w.deviations(x // 2**20, 2, [s >> 20 for s in sums]) == [sum((2 * int(a) - (s >> 20)) ** 2 for a, s in zip(v, sums, strict=True)) for v in x // 2**20]
