"""Worked examples of the raw-record pipeline (dedup, parse, cap, level split, union)."""

import datetime as dt

from pyspark.sql import functions as F

from spanwise.config import DEFAULT, Profile
from spanwise.operators import clean, temporal
from spanwise.plans import pipeline

COLS = "oblast string, raion string, hromada string, level string, started_at string, finished_at string, source string"
R1 = "Харківська область"

# our own fixture rows, one per case listed in FIXTURES.md F1
ROWS = [
    (R1, None, None, "oblast", "2024-03-01 02:00:00+00:00", "2024-03-01 03:30:00+00:00", "a"),
    (R1, None, None, "oblast", "2024-03-01 02:00:00+00:00", "2024-03-01 03:30:00+00:00", "b"),  # exact duplicate
    (R1, "Чугуївський", None, "raion", "2024-03-01 02:45:00+00:00", "2024-03-01 04:00:00+00:00", "a"),
    (R1, None, "Балаклійська", "hromada", "2024-03-01 05:00:00+00:00", "2024-03-01 05:30:00+00:00", "a"),  # uncovered
    (R1, None, "Зміївська", "hromada", "2024-03-01 03:00:00+00:00", "2024-03-01 03:10:00+00:00", "a"),  # covered
    ("Сумська область", "Сумський", None, "raion", "2024-03-01 02:05:00+00:00", "2024-03-01 03:00:00+00:00", "a"),
    ("Сумська область", "Охтирський", None, "raion", "2024-03-01 02:30:00+00:00", "2024-03-01 03:20:00+00:00", "a"),
    ("Луганська область", None, None, "oblast", "2024-03-02 00:00:00+00:00", "2024-03-02 23:59:00+00:00", "a"),
    ("Одеська область", None, None, "oblast", "NOT_A_DATE", "2024-03-02 01:00:00+00:00", "a"),
    ("Одеська область", None, None, "oblast", "2024-03-03 10:00:00+00:00", None, "a"),
    ("Одеська область", None, None, "region", "2024-03-03 12:00:00+00:00", "2024-03-03 13:00:00+00:00", "a"),
]


def _episodes(spark, rows=ROWS, profile=DEFAULT):
    raw = spark.createDataFrame(rows, COLS)
    return pipeline.episodes(raw, profile)


def test_union_worked_examples(spark):
    eps = {(r.region, r.started_at, r.finished_at) for r in _episodes(spark).collect()}
    t = dt.datetime
    assert ("Харківська", t(2024, 3, 1, 2, 0), t(2024, 3, 1, 4, 0)) in eps
    assert ("Харківська", t(2024, 3, 1, 5, 0), t(2024, 3, 1, 5, 30)) in eps
    assert ("Сумська", t(2024, 3, 1, 2, 5), t(2024, 3, 1, 3, 20)) in eps
    assert ("Одеська", t(2024, 3, 3, 10, 0), None) in eps
    # excluded region, bad start and unknown level never reach the union
    assert not any(r[0] == "Луганська" for r in eps)
    assert len(eps) == 4


def test_duration_cap_then_exclusion(spark):
    raw = spark.createDataFrame(ROWS, COLS)
    recs = clean.prepare_records(raw, DEFAULT)
    lug = recs.filter(F.col("oblast").startswith("Луганська")).collect()[0]
    assert (lug.finished_at - lug.started_at) == dt.timedelta(hours=12)


def test_dedup_ignores_source(spark):
    raw = spark.createDataFrame(ROWS, COLS)
    assert clean.dedup_raw(raw).count() == len(ROWS) - 1


def test_touching_intervals_merge_and_strict_cover(spark):
    rows = [
        ("Київська область", "Бучанський", None, "raion", "2024-01-01 10:00:00+00:00", "2024-01-01 12:00:00+00:00", "a"),
        ("Київська область", "Обухівський", None, "raion", "2024-01-01 12:00:00+00:00", "2024-01-01 14:00:00+00:00", "a"),
        ("Київська область", None, "Ірпінська", "hromada", "2024-01-01 14:00:00+00:00", "2024-01-01 15:00:00+00:00", "a"),
    ]
    eps = _episodes(spark, rows).orderBy("started_at").collect()
    # touching raion rows merge; the locality starting exactly at the end is uncovered (strict) and touches too
    assert [(e.started_at.hour, e.finished_at.hour) for e in eps] == [(10, 15)]


def test_open_row_reopens_episode_and_next_starts_new(spark):
    rows = [
        ("Одеська область", None, None, "oblast", "2024-01-01 10:00:00+00:00", "2024-01-01 12:00:00+00:00", "a"),
        ("Одеська область", "Одеський", None, "raion", "2024-01-01 11:00:00+00:00", None, "a"),
        ("Одеська область", "Білгород-Дністровський", None, "raion", "2024-01-01 11:30:00+00:00", "2024-01-01 11:40:00+00:00", "a"),
    ]
    eps = _episodes(spark, rows).orderBy("started_at").collect()
    assert [(e.started_at.strftime("%H:%M"), e.finished_at) for e in eps] == [("10:00", None), ("11:30", eps[1].finished_at)]
    assert eps[1].finished_at == dt.datetime(2024, 1, 1, 11, 40)


def test_empty_input_gives_typed_empty_frame(spark):
    raw = spark.createDataFrame([], COLS)
    eps = _episodes(spark, [])
    assert eps.columns == ["region", "started_at", "finished_at", "duration_min"]
    assert eps.count() == 0
    assert raw.count() == 0


def test_analysis_frame_contract(spark):
    frame = pipeline.analysis_frame(_episodes(spark), DEFAULT)
    for c in temporal.FEATURE_COLUMNS:
        assert c in frame.columns
    r = frame.filter(F.col("region") == "Сумська").collect()[0]
    # 02:05 UTC on 2024-03-01 is 04:05 in Kyiv (UTC+2), a Friday
    assert (r.hour, r.dow, r.dow_name, r.month_name, r.week) == (4, 4, "Friday", "March", 9)
    assert r.censored is False and abs(r.duration_min - 75.0) < 1e-9


def test_dst_local_time_and_durations(spark):
    df = spark.createDataFrame(
        [("X", dt.datetime(2024, 10, 27, 0, 30), dt.datetime(2024, 10, 27, 1, 30)),
         ("X", dt.datetime(2024, 3, 31, 0, 30), dt.datetime(2024, 3, 31, 1, 30))],
        "region string, started_at timestamp_ntz, finished_at timestamp_ntz")
    out = temporal.prepare(df, Profile(excluded=()), exclude_permanent=False).orderBy("started_at").collect()
    # spring: 00:30Z = 02:30 local (EET), 01:30Z = 04:30 local (EEST); autumn fold: 00:30Z = 03:30 local
    assert out[0].local_start == dt.datetime(2024, 3, 31, 2, 30)
    assert out[1].local_start == dt.datetime(2024, 10, 27, 3, 30)
    assert all(abs(r.duration_min - 60.0) < 1e-9 for r in out)


def test_mixed_timestamp_formats_parse_per_row(spark):
    from spanwise.functions.timecols import parse_instant
    df = spark.createDataFrame([("2024-01-01 10:00:00+02:00",), ("2024-01-01T08:00:00Z",), ("2024-01-01 08:00:00",),
                                ("2024-01-01 08:00:00.250+0000",), ("garbage",), (None,)], "s string")
    got = [r.t for r in df.select(parse_instant("s").alias("t")).collect()]
    assert got[:3] == [dt.datetime(2024, 1, 1, 8, 0)] * 3
    assert got[3] == dt.datetime(2024, 1, 1, 8, 0, 0, 250000)
    assert got[4] is None and got[5] is None


def test_results_do_not_depend_on_session_time_zone(spark):
    rows = [("Одеська область", None, None, "oblast", "2024-10-27 00:30:00+00:00", "2024-10-27 01:30:00+03:00", "a"),
            ("Одеська область", None, None, "oblast", "2024-03-31 01:30:00Z", "2024-03-31 03:30:00+01:00", "a")]
    def run():
        f = pipeline.analysis_frame(_episodes(spark, rows), DEFAULT)
        return sorted((r.started_at, r.finished_at, r.local_start, r.hour, r.date, r.duration_min) for r in f.collect())
    before = run()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        after = run()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert before == after
    # 01:30+03:00 is 22:30Z the previous day: an end before the start stays as given (no cap, no swap)
    assert before[1][0] == dt.datetime(2024, 10, 27, 0, 30)
