"""Known values and invariants of the analytics (FIXTURES.md F5, F6, F9, F10)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spanwise.config import Profile
from spanwise.operators import cross_region, describe, seasonal, shape, survival, temporal

PROFILE = Profile(excluded=())


def frame(spark, rows):
    df = spark.createDataFrame(rows, "region string, started_at timestamp_ntz, finished_at timestamp_ntz")
    return temporal.prepare(df, PROFILE, exclude_permanent=False)


def curve(spark, pts, label="x"):
    return spark.createDataFrame([(label, float(t), float(s), 0.0, 0.0) for t, s in pts],
                                 "label string, timeline double, survival double, ci_lower double, ci_upper double")


FIVE = [(0, 1.0), (30, 0.8), (60, 0.6), (90, 0.4), (120, 0.2)]


def test_hazard_known_values(spark):
    km = curve(spark, FIVE)
    h = {r.timeline: r.hazard for r in survival.hazard(km).collect()}
    assert h[0.0] == pytest.approx(0.2 / 30)
    assert h[30.0] == pytest.approx(0.2 / 24)
    assert h[120.0] is None
    at45 = survival.hazard_at(km, 45).collect()[0].hazard
    assert at45 == pytest.approx(0.2 / 24)
    assert survival.hazard_at(km, -1).count() == 0


def test_hazard_non_monotone_is_null(spark):
    km = curve(spark, [(0, 1.0), (30, 0.6), (60, 0.8)])
    h = {r.timeline: r.hazard for r in survival.hazard(km).collect()}
    assert h[30.0] is None


def test_median_remaining_known_values(spark):
    m = {r.elapsed: r.median_remaining for r in survival.median_remaining(curve(spark, FIVE)).collect()}
    assert m[0.0] == 90.0 and m[30.0] == 60.0
    assert m[120.0] is None


def test_km_median_and_cap(spark):
    km = curve(spark, [(0, 1.0), (30, 0.8), (60, 0.6), (90, 0.4)], "a").unionByName(
        curve(spark, [(0, 1.0), (30, 0.8), (60, 0.6)], "b"))
    got = {r.label: (r.median_min, r.capped) for r in survival.km_median(km).collect()}
    assert got == {"a": (90.0, False), "b": (600.0, True)}


def test_kaplan_meier_exact_without_censoring(spark):
    rows = [("k", dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 1, 0, m)) for m in (10, 10, 20, 30, 40)]
    km = survival.kaplan_meier(frame(spark, rows)).orderBy("timeline").collect()
    assert [(r.timeline, r.survival) for r in km] == [(0.0, 1.0), (10.0, 0.6), (20.0, 0.4), (30.0, 0.2), (40.0, 0.0)]
    assert km[0].ci_lower == km[0].ci_upper == 1.0
    assert km[1].ci_lower < 0.6 < km[1].ci_upper


def test_kaplan_meier_with_censoring_keeps_final_zero(spark):
    rows = spark.createDataFrame([(10.0, False), (20.0, True), (30.0, False)], "duration_min double, censored boolean")
    km = {r.timeline: r.survival for r in survival.kaplan_meier(rows).collect()}
    assert km[10.0] == pytest.approx(2 / 3)
    assert km[20.0] == pytest.approx(2 / 3)
    assert km[30.0] == 0.0


def test_binary_series_cases(spark):
    d = dt.datetime
    closed = frame(spark, [("Kyiv", d(2024, 1, 1, 8), d(2024, 1, 1, 10))])  # local 10:00-12:00
    got = {(r.bucket.hour, r.region): r.active for r in temporal.binary_series(closed).collect()}
    assert got == {(8, "Kyiv"): 1, (9, "Kyiv"): 1, (10, "Kyiv"): 0}
    mixed = frame(spark, [("Kyiv", d(2024, 1, 1, 8), d(2024, 1, 1, 9)), ("Lviv", d(2024, 1, 1, 12), None)])
    got = {(r.bucket.hour, r.region): r.active for r in temporal.binary_series(mixed).collect()}
    assert got[(12, "Lviv")] == 1 and got[(9, "Kyiv")] == 0 and set(got.values()) <= {0, 1}
    all_open = frame(spark, [("Kyiv", d(2024, 1, 1, 8), None), ("Kyiv", d(2024, 1, 1, 12), None)])
    got = {(r.bucket.hour, r.region): r.active for r in temporal.binary_series(all_open).collect()}
    assert got[(12, "Kyiv")] == 1 and (13, "Kyiv") in got


def test_rolling_mean_needs_seven_days(spark):
    rows = [("Kyiv", dt.datetime(2024, 1, 1, 10) + dt.timedelta(days=i), None) for i in range(14)]
    out = seasonal.rolling_7d(frame(spark, rows)).orderBy("date").collect()
    assert [r.rolling_7d for r in out[:6]] == [None] * 6
    assert all(r.rolling_7d == 1.0 for r in out[6:])


def test_hour_region_shares_sum_to_one(spark):
    rows = [("Kyiv", dt.datetime(2024, 1, 1, h), None) for h in range(24)]
    rows += [("Lviv", dt.datetime(2024, 1, 1, h), None) for h in range(12)]
    out = seasonal.hour_region(frame(spark, rows), normalize=True)
    sums = {r.region: r.s for r in out.groupBy("region").agg(F.sum("share").alias("s")).collect()}
    assert sums["Kyiv"] == pytest.approx(1.0) and sums["Lviv"] == pytest.approx(1.0)


def test_hour_dow_grid_and_night_split(spark):
    rows = [("Kyiv", dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), None) for i in range(60)]
    f = frame(spark, rows)
    assert seasonal.hour_dow_rate(f).count() == 24 * 7
    n = seasonal.night_ratio(f).collect()[0]
    assert n.night_count + n.day_count == 60


def test_constant_counts_give_null_correlation(spark):
    rows = [(r, dt.datetime(2024, 1, 1, 10) + dt.timedelta(days=i), None) for i in range(10) for r in "abc"]
    out = cross_region.rank_correlation(frame(spark, rows)).collect()
    assert len(out) == 9 and all(r.value is None for r in out)


def test_varying_counts_give_unit_diagonal(spark):
    rows = []
    for i in range(9):
        for r in "ab":
            rows += [(r, dt.datetime(2024, 1, 1, 10) + dt.timedelta(days=i, minutes=k), None) for k in range(i % 3 + 1)]
    out = {(r.region_a, r.region_b): r.value for r in cross_region.rank_correlation(frame(spark, rows)).collect()}
    assert out[("a", "a")] == 1.0 and out[("a", "b")] == out[("b", "a")]


def test_duration_stats_contract(spark):
    rows = [("k", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for m in range(1, 101)]
    s = describe.duration_stats(frame(spark, rows)).collect()[0]
    assert s.p25_min <= s.median_min <= s.p75_min <= s.p95_min <= s.max_min
    assert s.median_min == 50.5
    empty = frame(spark, [("k", dt.datetime(2024, 1, 1), None)])
    assert describe.duration_stats(empty).count() == 0
    with pytest.raises(ValueError):
        describe.duration_stats(spark.createDataFrame([(1.0,)], "duration_min double"))


def test_histogram_excludes_values_above_max(spark):
    rows = [("k", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for m in (0, 5, 300, 301)]
    h = describe.duration_histogram(frame(spark, rows), 300.0, 60).orderBy("bin").collect()
    assert len(h) == 60 and h[0].n_total == 4 and h[0].n_excluded == 1
    assert h[0]["count"] == 1 and h[1]["count"] == 1 and h[59]["count"] == 1


def test_cumulative_is_monotone_and_zero_filled(spark):
    rows = [("k", dt.datetime(2024, 1, d, 10), None) for d in (1, 1, 4)]
    out = describe.cumulative_daily(frame(spark, rows)).orderBy("date").collect()
    assert [r.daily_count for r in out] == [2, 0, 0, 1]
    assert [r.cumulative for r in out] == [2, 2, 2, 3]


def test_weekly_labels_are_sundays(spark):
    rows = [("k", dt.datetime(2024, 1, 1, 10), None), ("k", dt.datetime(2024, 1, 16, 10), None)]
    out = describe.frequency_over_time(frame(spark, rows), "W").orderBy("period").collect()
    assert [r.period for r in out] == [dt.date(2024, 1, 7), dt.date(2024, 1, 14), dt.date(2024, 1, 21)]
    assert [r.alert_count for r in out] == [1, 0, 1]


def test_timeline_ranks_every_episode(spark):
    rows = [(f"R{i:02d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=2 * j), dt.datetime(2024, 1, 1) + dt.timedelta(hours=2 * j, minutes=40 + j))
            for i in range(25) for j in range(20)]
    rows.append(("R00", dt.datetime(2024, 1, 9), None))
    out = shape.timeline_sample(frame(spark, rows))
    assert out.count() == len(rows)  # no row is dropped, whatever the number of rows
    one = out.filter("region = 'R00'").orderBy("rank_in_region").collect()
    assert [r.rank_in_region for r in one] == list(range(1, 22))
    assert [r.duration_min for r in one[:20]] == [float(59 - j) for j in range(20)]
    assert one[20].finished_at is None and one[20].plot_end == dt.datetime(2024, 1, 9)
    assert shape.timeline_sample(frame(spark, rows), per_region=16).count() == 25 * 16


def test_wave_order_and_positions(spark):
    t = dt.datetime
    rows = [(r, t(2024, 1, 1, h, m), None) for h in (6, 12) for m, r in enumerate("abc")]  # two equal waves on one day
    rows += [(r, t(2024, 1, 2, 9, m), None) for m, r in enumerate("abcd")]
    wv = cross_region.waves(frame(spark, rows), 3, 1.0)
    ranked = [(w.rank, w.wave_start) for w in wv.orderBy("rank").collect()]
    assert ranked == [(1, t(2024, 1, 2, 9)), (2, t(2024, 1, 1, 6)), (3, t(2024, 1, 1, 12))]
    listed = cross_region.wave_detail(wv)
    firsts = [(r.list_position, r.wave_start) for r in listed.filter("position = 0").orderBy("list_position").collect()]
    assert firsts == [(1, t(2024, 1, 2, 9)), (2, t(2024, 1, 1, 6)), (3, t(2024, 1, 1, 12))]  # ties in ascending time
    assert cross_region.wave_detail(wv, 2).select("wave_start").distinct().count() == 2


def test_top_days_ranks_all_days(spark):
    rows = [("k", dt.datetime(2024, 1, d, 10), None) for d in (1, 2, 2, 3)]
    out = describe.top_days(frame(spark, rows)).orderBy("rank").collect()
    assert [(r.date.day, r.alert_count) for r in out] == [(2, 2), (1, 1), (3, 1)]
    assert describe.top_days(frame(spark, rows), 1).count() == 1


def test_strata_are_listed_and_ordered(spark):
    rows = [("k", dt.datetime(2024, 1, 1, h), dt.datetime(2024, 1, 1, h, 10 + i)) for h, n in ((6, 3), (7, 1)) for i in range(n)]
    f = frame(spark, rows)  # local hours 8 and 9
    listed = [(r.position, r.label, r.n, r.kept) for r in survival.strata_counts(f, "hour", [9, 8, 5], 2).orderBy("position").collect()]
    assert listed == [(0, "9", 1, False), (1, "8", 3, True), (2, "5", 0, False)]
    curves = survival.kaplan_meier_stratified(f, "hour", [9, 8, 5], 2, labels={"8": "eight"})
    assert {(r.label, r.position) for r in curves.collect()} == {("eight", 1)}


def test_truncation_marks_points(spark):
    km = curve(spark, [(0, 1.0), (10, 0.04), (20, 0.0)])
    out = survival.km_truncated(km).orderBy("timeline").collect()
    assert [(r.timeline, r.shown) for r in out] == [(0.0, True), (10.0, True), (20.0, False)]


def test_median_remaining_between_points(spark):
    km = curve(spark, FIVE)
    at = lambda t: survival.median_remaining_at(km, t).collect()[0].median_remaining
    assert at(0) == 90.0 and at(30) == 60.0
    assert at(45) == 75.0  # S is read at 60 (0.6); 0.3 is reached at 120
    assert at(200) is None and at(100) is None


def test_custom_timeline_is_a_step_function(spark):
    rows = spark.createDataFrame([(10.0, False), (20.0, False)], "duration_min double, censored boolean")
    got = {r.timeline: r.survival for r in survival.kaplan_meier(rows, timeline=[0, 9.5, 10, 15, 400]).collect()}
    assert got == {0.0: 1.0, 9.5: 1.0, 10.0: 0.5, 15.0: 0.5, 400.0: 0.0}


def test_kaplan_meier_published_remission_times(spark):
    """Freireich's 6-MP remission times (weeks), the textbook example; published S(t) and the
    log-log 95 % band at 6 and 10 weeks."""
    done = [6, 6, 6, 7, 10, 13, 16, 22, 23]
    lost = [6, 9, 10, 11, 17, 19, 20, 25, 32, 32, 34, 35]
    rows = spark.createDataFrame([(float(t), False) for t in done] + [(float(t), True) for t in lost], "duration_min double, censored boolean")
    km = {r.timeline: r for r in survival.kaplan_meier(rows).collect()}
    published = {6: 0.857, 7: 0.807, 10: 0.753, 13: 0.690, 16: 0.627, 22: 0.538, 23: 0.448}
    for t, s in published.items():
        assert km[float(t)].survival == pytest.approx(s, abs=6e-4)
    assert (round(km[6.0].ci_lower, 3), round(km[6.0].ci_upper, 3)) == (0.620, 0.952)
    assert (round(km[10.0].ci_lower, 3), round(km[10.0].ci_upper, 3)) == (0.503, 0.889)


def test_kaplan_meier_as_of_censors_open_episodes(spark):
    d = dt.datetime
    rows = [("k", d(2024, 1, 1, 0, 0), d(2024, 1, 1, 0, 10)), ("k", d(2024, 1, 1, 0, 0), None),
            ("k", d(2024, 1, 1, 0, 0), d(2024, 1, 1, 0, 30))]
    f = frame(spark, rows)
    default = {r.timeline: r.survival for r in survival.kaplan_meier(f).collect()}
    assert default == {0.0: 1.0, 10.0: 0.5, 30.0: 0.0}  # the open episode has no duration
    km = {r.timeline: r.survival for r in survival.kaplan_meier(f, as_of="2024-01-01 00:20:00").collect()}
    assert km[10.0] == pytest.approx(2 / 3) and km[20.0] == pytest.approx(2 / 3) and km[30.0] == 0.0


def test_lower_triangle_view(spark):
    rows = [(r, dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=7 * i), None) for i, r in enumerate("abcabc")]
    full = {(r.region_a, r.region_b): r.value for r in cross_region.co_occurrence(frame(spark, rows), 2.0).collect()}
    tri = {(r.region_a, r.region_b): r.value
           for r in cross_region.co_occurrence(frame(spark, rows), 2.0, lower_triangle=True).collect()}
    assert set(tri) == {(a, b) for a, b in full if a > b}
    assert all(tri[k] == full[k] == full[(k[1], k[0])] for k in tri)


def test_daily_binary_series_in_local_time(spark):
    d = dt.datetime
    # 23:00Z on Jan 1 is 01:00 on Jan 2 in Kyiv: the local daily bucket is Jan 2
    f = frame(spark, [("Kyiv", d(2024, 1, 1, 23, 0), d(2024, 1, 1, 23, 30))])
    utc = {r.bucket for r in temporal.binary_series(f, 86400, dense=False).collect()}
    local = {r.bucket for r in temporal.binary_series(f, 86400, dense=False, tz="Europe/Kyiv").collect()}
    assert utc == {d(2024, 1, 1)} and local == {d(2024, 1, 2)}
