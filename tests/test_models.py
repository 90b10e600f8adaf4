"""Randomised comparison of the parallel operators with sequential brute-force models.

Cases include open, touching, zero-length, negative-length, tied and duplicate
rows, and several chunk sizes (so carries cross many chunk boundaries).
"""

import datetime as dt
import random

import pytest

from spanwise.operators import cross_region, unify

BASE = dt.datetime(2024, 1, 1)


def ts(m):
    return None if m is None else BASE + dt.timedelta(minutes=m)


def mins(t):
    return None if t is None else int((t - BASE).total_seconds() // 60)


def key(t):
    return (t[0], t[1], t[2] is None, t[2] or 0)


def model_merge(rows):
    """Union from its definition: within a key, rows of one segment (open rows end segments) are
    connected when a later one starts no later than an earlier closed one ends; an episode is a
    connected component, open if it holds an open row."""
    out = []
    for k in {r[0] for r in rows}:
        order = sorted(((s, e) for kk, s, e in rows if kk == k), key=lambda t: (t[0], t[1] is None, t[1] or 0))
        segment = [sum(e is None for _, e in order[:i]) for i in range(len(order))]
        group = {i: {i} for i in range(len(order))}
        for j, (s, _) in enumerate(order):
            for i in range(j):
                if segment[i] == segment[j] and order[i][1] is not None and s <= order[i][1]:
                    joined = group[i] | group[j]
                    group.update(dict.fromkeys(joined, joined))
        for members in {frozenset(g) for g in group.values()}:
            ends = [order[i][1] for i in members]
            out.append((k, min(order[i][0] for i in members), None if None in ends else max(ends)))
    return sorted(out, key=key)


def model_uncovered(fine, base, cap):
    res = []
    for k, s, e in fine:
        if k is None:
            continue
        ee = e if e is not None else s + cap
        if not any(bk == k and s < (be if be is not None else bs + cap) and ee > bs for bk, bs, be in base):
            res.append((k, s, e))
    return sorted(res, key=key)


def random_rows(rng, n, keys="abc"):
    rows = []
    for _ in range(n):
        s = rng.randint(0, 900)
        r = rng.random()
        e = None if r < 0.15 else s + rng.choice([0, 0, rng.randint(-5, 150), rng.randint(0, 30)])
        rows.append((rng.choice(keys), s, e))
    if rows and rng.random() < 0.5:
        rows.append(rows[0])  # duplicate
    return rows


@pytest.mark.parametrize("seed", range(12))
def test_merge_matches_model(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, rng.randint(1, 80))
    df = spark.createDataFrame([(k, ts(s), ts(e)) for k, s, e in rows],
                               "region string, started_at timestamp_ntz, finished_at timestamp_ntz")
    got = unify.merge_intervals(df, chunk_seconds=rng.choice([300, 1800, 3600, 86400])).collect()
    got = sorted([(r.region, mins(r.started_at), mins(r.finished_at)) for r in got], key=key)
    assert got == model_merge(rows)


@pytest.mark.parametrize("seed", range(8))
def test_uncovered_matches_model(spark, seed):
    rng = random.Random(100 + seed)
    base = random_rows(rng, rng.randint(0, 60))
    fine = [(rng.choice(["a", "b", "d", None]), s, e) for _, s, e in random_rows(rng, 25)]
    cap = 60
    schema = "oblast string, started_at timestamp_ntz, finished_at timestamp_ntz"
    fdf = spark.createDataFrame([(k, ts(s), ts(e)) for k, s, e in fine], schema)
    bdf = spark.createDataFrame([(k, ts(s), ts(e)) for k, s, e in base], schema)
    got = unify.uncovered_fine(fdf, bdf, cap * 60, chunk_seconds=rng.choice([600, 3600])).collect()
    got = sorted([(r.oblast, mins(r.started_at), mins(r.finished_at)) for r in got], key=key)
    assert got == model_uncovered(fine, base, cap)


def model_waves(starts, n_min, w):
    """Waves from their definition: a start time is a candidate if its window holds n_min regions;
    the waves are the least candidate, then each time the least one after the last window."""
    def hit(t):
        return {r for r, m in starts if t <= m <= t + w}

    candidates = {m for _, m in starts if len(hit(m)) >= n_min}
    chosen = []
    while later := {c for c in candidates if not chosen or c > chosen[-1] + w}:
        chosen.append(min(later))
    return [(t, len(hit(t))) for t in chosen]


@pytest.mark.parametrize("seed", range(6))
def test_waves_match_definition(spark, seed):
    rng = random.Random(200 + seed)
    starts = [(rng.choice("abcdefgh"), rng.randint(0, 2000)) for _ in range(rng.randint(5, 120))]
    df = spark.createDataFrame([(r, ts(m)) for r, m in starts], "region string, started_at timestamp_ntz")
    n_min, w_h = rng.choice([2, 3, 4]), rng.choice([0.5, 1.0, 3.0])
    got = cross_region.waves(df, n_min, w_h).collect()
    got = sorted((mins(r.wave_start), r.regions_hit) for r in got)
    assert got == model_waves(starts, n_min, int(w_h * 60))


@pytest.mark.parametrize("seed", range(4))
def test_co_occurrence_matches_brute_force(spark, seed):
    rng = random.Random(300 + seed)
    starts = [(rng.choice("abcd"), rng.randint(0, 1500)) for _ in range(rng.randint(3, 80))]
    df = spark.createDataFrame([(r, ts(m)) for r, m in starts], "region string, started_at timestamp_ntz")
    got = {(r.region_a, r.region_b): r.value for r in cross_region.co_occurrence(df, 2.0).collect()}
    regions = sorted({r for r, _ in starts})

    def p(a, b):
        ta = [m for r, m in starts if r == a]
        return sum(any(abs(x - y) <= 120 for rr, y in starts if rr == b) for x in ta) / len(ta)

    for a in regions:
        for b in regions:
            if a == b:
                assert got[(a, b)] is None
            else:
                assert abs(got[(a, b)] - (p(a, b) + p(b, a)) / 2) < 1e-12


def test_adjacent_bursts_merge_into_one_wave(spark):
    # five regions from 10:00 every 20 min, five more from 10:30 every 20 min; N = 5, 3 h window
    rows = [(f"r{i}", dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=20 * i)) for i in range(5)]
    rows += [(f"q{i}", dt.datetime(2024, 1, 1, 10, 30) + dt.timedelta(minutes=20 * i)) for i in range(5)]
    df = spark.createDataFrame(rows, "region string, started_at timestamp_ntz")
    w = cross_region.waves(df, 5, 3.0).collect()
    assert len(w) == 1 and w[0].regions_hit == 10
    seq = [x.region for x in w[0].sequence]
    assert len(seq) == len(set(seq)) == 10
    assert w[0].duration_h <= 3.0


@pytest.mark.parametrize("seed", range(6))
def test_single_pass_base_plus_uncovered_matches_model(spark, seed):
    rng = random.Random(400 + seed)
    base = [(k, s, e, rng.choice(["oblast", "raion"])) for k, s, e in random_rows(rng, rng.randint(0, 50))]
    fine = [(rng.choice(["a", "b", "d", None]), s, e, "hromada") for _, s, e in random_rows(rng, 25)]
    other = [("a", 10, 20, "region")]
    cap = 60
    recs = spark.createDataFrame([(k, lv, ts(s), ts(e)) for k, s, e, lv in base + fine + other],
                                 "oblast string, level string, started_at timestamp_ntz, finished_at timestamp_ntz")
    got = unify.with_uncovered(recs, cap * 60, chunk_seconds=rng.choice([600, 3600])).collect()
    got = sorted([(r.oblast, mins(r.started_at), mins(r.finished_at)) for r in got], key=key)
    exp = sorted([(k, s, e) for k, s, e, _ in base] +
                 model_uncovered([(k, s, e) for k, s, e, _ in fine], [(k, s, e) for k, s, e, _ in base], cap), key=key)
    assert got == exp


@pytest.mark.parametrize("seed", range(5))
def test_unit_coverage_matches_brute_force(spark, seed):
    from spanwise.operators import coverage
    rng = random.Random(500 + seed)
    units = []
    for _ in range(rng.randint(1, 60)):
        s = rng.randint(0, 900)
        e = None if rng.random() < 0.2 else s + rng.randint(-5, 120)
        units.append((rng.choice("ab"), rng.choice(["u1", "u2", "u3", "u4"]), s, e))
    eps = []
    for _ in range(rng.randint(1, 25)):
        s = rng.randint(0, 900)
        e = None if rng.random() < 0.25 else s + rng.randint(0, 200)
        eps.append((rng.choice("abc"), s, e))
    udf = spark.createDataFrame([(r, u, "raion", ts(s), ts(e)) for r, u, s, e in units],
                                "region string, unit_name string, level string, started_at timestamp_ntz, finished_at timestamp_ntz")
    edf = spark.createDataFrame([(r, ts(s), ts(e), None) for r, s, e in eps],
                                "region string, started_at timestamp_ntz, finished_at timestamp_ntz, duration_min double")
    got = sorted((r.region, mins(r.started_at), mins(r.finished_at), r.unit_count)
                 for r in coverage.episode_unit_coverage(udf, edf, bin_seconds=rng.choice([600, 3600])).collect())

    def count(r, s, e):
        if e is None:
            active = {u for rr, u, us, ue in units if rr == r and us >= s}
        else:
            active = {u for rr, u, us, ue in units if rr == r and us < e and (ue is None or ue > s)}
        return len(active)

    exp = sorted((r, s, e, count(r, s, e)) for r, s, e in eps)
    assert [(a, b, c is None, c or 0, d) for a, b, c, d in got] == [(a, b, c is None, c or 0, d) for a, b, c, d in exp]


@pytest.mark.parametrize("seed", range(3))
def test_lag_correlation_matches_direct_pearson(spark, seed):
    import math
    from spanwise.operators import cross_region
    rng = random.Random(600 + seed)
    rows = []
    for _ in range(rng.randint(4, 30)):
        s = rng.randint(0, 60 * 40)
        rows.append((rng.choice("abc"), s, s + rng.randint(1, 300)))
    df = spark.createDataFrame([(r, ts(s), ts(e)) for r, s, e in rows],
                               "region string, started_at timestamp_ntz, finished_at timestamp_ntz")
    got = {(r.region_a, r.region_b, r.lag_hours): r.correlation for r in cross_region.lag_correlation(df, 3).collect()}
    lo = min(s for _, s, _ in rows) // 60
    hi = -(-max(e for _, _, e in rows) // 60)
    idx = list(range(lo, hi + 1))
    series = {g: [1 if any(r == g and s // 60 <= i < -(-e // 60) for r, s, e in rows) else 0 for i in idx]
              for g in {r for r, _, _ in rows}}

    def pearson(x, y):
        n = len(x)
        mx, my = sum(x) / n, sum(y) / n
        sxy = sum((a - mx) * (b - my) for a, b in zip(x, y))
        sxx = sum((a - mx) ** 2 for a in x)
        syy = sum((b - my) ** 2 for b in y)
        return None if sxx == 0 or syy == 0 else sxy / math.sqrt(sxx * syy)

    for (a, b, lag), v in got.items():
        x, y = series[a], series[b]
        # b shifted by lag: pairs (x[i], y[i - lag]) where both exist
        pairs = [(x[i], y[i - lag]) for i in range(len(idx)) if 0 <= i - lag < len(idx)]
        want = pearson([p[0] for p in pairs], [p[1] for p in pairs])
        if want is None:
            assert v is None
        else:
            assert v == pytest.approx(round(want, 4), abs=1.1e-4)


def test_hot_hour_reduces_to_distinct_instants(spark):
    """Most rows in one region-hour: the window input is bounded by the hour's instants."""
    rng = random.Random(7)
    rows = [("hot", rng.randint(0, 59), None) for _ in range(3)]
    rows += [("hot", s, s + rng.randint(0, 90)) for s in (rng.randint(0, 59) for _ in range(3000))]
    rows += [("cold", 10, 20), ("cold", 15, 40)]
    df = spark.createDataFrame([(k, ts(s), ts(e)) for k, s, e in rows],
                               "region string, started_at timestamp_ntz, finished_at timestamp_ntz")
    got = unify.merge_intervals(df, with_count=True).collect()
    assert sorted([(r.region, mins(r.started_at), mins(r.finished_at)) for r in got], key=key) == model_merge(rows)
    assert sum(r.n_records for r in got) == len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_match_sorted_values(spark, seed):
    from spanwise.operators import describe
    rng = random.Random(700 + seed)
    values = [rng.choice([rng.random() * 500, float(rng.randint(0, 20)), -3.5]) for _ in range(rng.randint(1, 60))]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = describe.exact_quantiles(df, "v", probs).first()["q"]
    ranked = sorted(values)
    for p, g in zip(probs, got):
        at = (len(ranked) - 1) * p
        lo, hi = ranked[int(at)], ranked[min(int(at) + 1, len(ranked) - 1)]
        assert g == pytest.approx(lo + (hi - lo) * (at - int(at)))


@pytest.mark.parametrize("seed", range(3))
def test_kendall_matches_day_pairs(spark, seed):
    import math
    rng = random.Random(800 + seed)
    days = 9
    counts = {r: [rng.randint(0, 3) for _ in range(days)] for r in "abc"}
    counts["d"] = [1] * days  # no variance, and every day occurs
    rows = [(r, dt.datetime(2024, 1, 1 + d), dt.date(2024, 1, 1 + d)) for r, c in counts.items() for d in range(days) for _ in range(c[d])]
    df = spark.createDataFrame(rows, "region string, started_at timestamp_ntz, date date")
    got = {(r.region_a, r.region_b): r.value for r in cross_region.rank_correlation(df, "kendall").collect()}

    def sign(x):
        return (x > 0) - (x < 0)

    present = [r for r in counts if any(counts[r])]
    for a in present:
        for b in present:
            pairs = [(i, j) for i in range(days) for j in range(i)]
            x, y = counts[a], counts[b]
            s = sum(sign(x[i] - x[j]) * sign(y[i] - y[j]) for i, j in pairs)
            na, nb = (sum(v[i] != v[j] for i, j in pairs) for v in (x, y))
            want = 1.0 if a == b else s / math.sqrt(na * nb) if na and nb else None
            assert got[a, b] is None if want is None else got[a, b] == pytest.approx(round(want, 3), abs=1.1e-3)
    assert len(got) == len(present) ** 2


def test_replaced_input_rebuilds_stored_tables(spark, tmp_path):
    from spanwise.functions.stored import input_version
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    before = input_version(spark, path)
    assert before == input_version(spark, path)
    spark.range(5).write.mode("overwrite").parquet(path)
    assert before != input_version(spark, path)


@pytest.mark.parametrize("seed", range(2))
def test_kendall_with_all_values_distinct(spark, seed):
    """No two days of a region have one count: as many cells as days, every level of the rank blocks is used."""
    rng = random.Random(850 + seed)
    days = 23
    counts = {r: rng.sample(range(1, 60), days) for r in "abc"}
    counts["d"] = sorted(counts["a"])
    rows = [(r, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), dt.date(2024, 1, 1) + dt.timedelta(days=d)) for r, c in counts.items() for d in range(days) for _ in range(c[d])]
    df = spark.createDataFrame(rows, "region string, started_at timestamp_ntz, date date")
    out = cross_region.rank_correlation(df, "kendall")
    got = {(r.region_a, r.region_b): r.value for r in out.collect()}
    for a in counts:
        for b in counts:
            x, y = counts[a], counts[b]
            s = sum(1 if (x[i] - x[j]) * (y[i] - y[j]) > 0 else -1 for i in range(days) for j in range(i))
            assert got[a, b] == pytest.approx(round(s / (days * (days - 1) / 2), 3), abs=1.1e-3)


@pytest.mark.parametrize("chunk_minutes", [7, 60, 120, 1000, 100_000])
def test_wave_chain_at_any_chunk_width(spark, chunk_minutes):
    rng = random.Random(chunk_minutes)
    times = sorted({rng.randint(0, 3000) for _ in range(250)} | {5000, 5060, 5061, 9000})
    df = spark.createDataFrame([(t * 60_000_000,) for t in times], "_t long")
    got = sorted(r._t // 60_000_000 for r in cross_region.greedy_chain(df, 60 * 60_000_000, chunk_minutes * 60_000_000).collect())
    want = []
    for t in times:
        if not want or t > want[-1] + 60:
            want.append(t)
    assert got == want


def test_wave_chain_without_candidates(spark):
    assert cross_region.greedy_chain(spark.createDataFrame([], "_t long"), 1000).collect() == []


def test_coverage_of_touching_and_empty_intervals(spark):
    """Zero-length records and episodes, records that touch them, and reversed records."""
    from spanwise.operators import coverage
    units = [("u1", 0, 10), ("u1", 10, 20), ("u2", 10, 10), ("u3", 5, 15), ("u3", 6, 14), ("u4", 30, 25), ("u5", 2, 3), ("u5", 40, 41), (None, 0, 50)]
    eps = [(10, 10), (0, 10), (10, 20), (4, 30), (4, 31), (24, 31), (3, 40), (2, 41), (15, 15), (10, 10)]
    udf = spark.createDataFrame([("a", u, "raion", ts(s), ts(e)) for u, s, e in units],
                                "region string, unit_name string, level string, started_at timestamp_ntz, finished_at timestamp_ntz")
    edf = spark.createDataFrame([("a", ts(s), ts(e)) for s, e in eps], "region string, started_at timestamp_ntz, finished_at timestamp_ntz")
    got = sorted((mins(r.started_at), mins(r.finished_at), r.unit_count) for r in coverage.episode_unit_coverage(udf, edf).collect())
    assert got == sorted((s, e, len({u for u, us, ue in units if u and us < e and ue > s})) for s, e in eps)


@pytest.mark.parametrize("seed", range(3))
def test_coverage_with_an_as_of_time(spark, seed):
    from spanwise.operators import coverage
    rng = random.Random(900 + seed)
    units = [(rng.choice("ab"), rng.choice("uvwxyz"), s := rng.randint(0, 20_000), None if rng.random() < 0.3 else s + rng.randint(0, 400)) for _ in range(120)]
    merged = model_merge([(r, s, e) for r, _, s, e in units])
    now = 9_000
    udf = spark.createDataFrame([(r, u, "raion", ts(s), ts(e)) for r, u, s, e in units],
                                "region string, unit_name string, level string, started_at timestamp_ntz, finished_at timestamp_ntz")
    edf = spark.createDataFrame([(r, ts(s), ts(e)) for r, s, e in merged], "region string, started_at timestamp_ntz, finished_at timestamp_ntz")
    out = coverage.episode_unit_coverage(udf, edf, as_of=ts(now), disjoint=seed > 0)
    got = sorted(((r.region, mins(r.started_at), mins(r.finished_at), r.unit_count) for r in out.collect()), key=key)

    def count(r, s, e):
        if e is None:
            return len({u for rr, u, us, _ in units if rr == r and us >= s})
        return len({u for rr, u, us, ue in units if rr == r and us < e and (now if ue is None else ue) > s})

    assert [t[3] for t in got] == [count(*t[:3]) for t in sorted(merged, key=key)]


def test_ranks_with_all_keys_tied(spark):
    """Every row equal, or equal but for the key: ranks are 1..n, and the rows are spread over tasks."""
    from spanwise.functions.scans import ranked
    from pyspark.sql import functions as F
    rows = spark.range(0, 4000, 1, 8).select(F.lit("a").alias("region"), F.lit(7.0).alias("x"))
    out = ranked(rows, ["region"], [F.desc_nulls_last("x")], "n")
    assert sorted(r.n for r in out.collect()) == list(range(1, 4001))
    files = [str(n) for n in out.inputFiles()]
    assert len(files) > 1 and max(spark.read.parquet(f).count() for f in files) < 3000
    keyed = spark.createDataFrame([(k, v) for k in ("a", "b", None) for v in (3, None, 1, 1, 2)], "region string, x int")
    got = {}
    for r in ranked(keyed, ["region"], [F.desc_nulls_last("x")], "n").collect():
        got.setdefault(r.region, []).append((r.n, r.x))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(1, 3), (2, 2), (3, 1), (4, 1), (5, None)] for k in ("a", "b", None)}
    assert sorted(r.n for r in ranked(keyed, [], [F.asc("x")], "n").collect()) == list(range(1, 16))


@pytest.mark.parametrize("seed", range(2))
def test_timeline_and_order_match_sorted_rows(spark, seed):
    from spanwise.operators import shape
    rng = random.Random(950 + seed)
    rows = [(rng.choice(["a", "b", "c"]), rng.randint(0, 30), rng.choice([None, 5, 5, 40])) for _ in range(90)]
    df = spark.createDataFrame([(r, ts(s), None if d is None else ts(s + d), None if d is None else float(d)) for r, s, d in rows],
                               "region string, started_at timestamp_ntz, finished_at timestamp_ntz, duration_min double")
    got = sorted((r.region, r.rank_in_region, mins(r.started_at), r.duration_min) for r in shape.timeline_sample(df).collect())
    want = []
    for region in "abc":
        mine = sorted(((s, d) for r, s, d in rows if r == region), key=lambda t: (t[1] is None, -(t[1] or 0), t[0]))
        want += [(region, i + 1, s, d) for i, (s, d) in enumerate(mine)]
    assert got == want
    placed = sorted((r.position, mins(r.started_at), r.region, mins(r.finished_at)) for r in unify.in_start_order(df).collect())
    ordered = sorted(rows, key=lambda t: (t[1], t[0], t[2] is None, t[2] or 0))
    assert placed == [(i + 1, s, r, None if d is None else s + d) for i, (r, s, d) in enumerate(ordered)]
