"""File sources and sinks, quality checks, reconciliation, coverage and the driver contract."""

import datetime as dt
import json
import os
import tempfile

import pytest

from spanwise.config import DEFAULT, Profile
from spanwise.operators import coverage, quality, reconcile
from spanwise.plans import pipeline
from spanwise.sources import files


def scratch():
    return tempfile.mkdtemp(prefix="spanwise-test-", dir="/tmp")


CSV = """ Oblast ,raion,hromada,LEVEL,started_at,finished_at,source
Сумська область,,,oblast,2024-01-01 10:00:00+00:00,2024-01-01 11:00:00+00:00,a
Сумська область,,,oblast,2024-01-01 10:00:00+00:00,2024-01-01 11:00:00+00:00,b
Сумська область,Сумський,,raion,2024-01-01T10:30:00Z,NaN,a
Київ,,,oblast,2024-01-01 12:00:00+02:00,None,a
Одеська область,,,oblast,NOT_A_DATE,,a
"""


def test_csv_scan_normalises_and_nulls(spark):
    d = scratch()
    p = os.path.join(d, "alerts.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(CSV)
    raw = files.read_alerts_csv(spark, p)
    assert set(raw.columns) >= {"oblast", "level", "started_at", "finished_at"}
    rows = raw.collect()
    assert rows[2].finished_at is None and rows[3].finished_at is None
    eps = pipeline.episodes(raw, DEFAULT).orderBy("region", "started_at").collect()
    got = [(e.region, e.started_at, e.finished_at) for e in eps]
    assert ("м. Київ", dt.datetime(2024, 1, 1, 10, 0), None) in got
    assert ("Сумська", dt.datetime(2024, 1, 1, 10, 0), None) in got
    assert len(got) == 2


def test_csv_missing_column_raises(spark):
    d = scratch()
    p = os.path.join(d, "bad.csv")
    with open(p, "w") as fh:
        fh.write("oblast,level,started_at\nX,oblast,2024-01-01 00:00:00\n")
    with pytest.raises(ValueError):
        files.read_alerts_csv(spark, p)


def _csv(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        fh.write(text)


HEAD = "oblast,raion,hromada,level,started_at,finished_at\n"


def test_columns_are_found_by_name_across_files(spark):
    d = scratch()
    _csv(d, "a.csv", HEAD + "A,r,h,oblast,2024-01-01 10:00:00,2024-01-01 11:00:00\n")
    _csv(d, "b.csv", " Started_At ,oblast,raion,hromada,LEVEL,finished_at,note\n2024-01-01 10:00:00,A,r,h,oblast,2024-01-01 11:00:00,n\n")
    _csv(d, "c d%20.csv", HEAD + "A,r,h,oblast,2024-01-01 10:00:00,2024-01-01 11:00:00\n")
    _csv(d, "empty.csv", "")
    rows = files.read_alerts_csv(spark, d).collect()
    assert len({tuple(r[c] for c in HEAD.strip().split(",")) for r in rows}) == 1 and len(rows) == 3
    assert sorted(str(r.note) for r in rows) == ["None", "None", "n"]
    _csv(d, "e.csv", "oblast,level\nA,oblast\n")  # a file without a required column
    with pytest.raises(ValueError, match="e.csv"):
        files.read_alerts_csv(spark, d)


def test_counters_come_with_the_load(spark):
    from spanwise.plans import pipeline as plan
    rows = [("A", None, None, "oblast", s, e) for s, e in (
        ("2024-01-01 10:00:00", "2024-01-01 11:00:00"), ("2024-01-01 10:00:00", "2024-01-01 11:00:00"), ("bad", None), ("bad", None),
        ("2024-01-02 10:00:00", "2024-01-05 10:00:00"), ("2024-01-03 10:00:00", None))]
    raw = spark.createDataFrame(rows, "oblast string, raion string, hromada string, level string, started_at string, finished_at string")
    counts = {}
    plan.unit_records(raw, DEFAULT, report=counts)
    assert counts == {"n_raw": 6, "n_distinct": 4, "n_bad_start": 1, "n_capped": 1}
    plan.unit_records(raw.limit(0), DEFAULT, report=counts)
    assert counts == {"n_raw": 0, "n_distinct": 0, "n_bad_start": 0, "n_capped": 0}


def test_matrices(spark):
    from spanwise.functions.matrix import to_matrix, transposed
    long = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("b", 2, 7.0), ("b", 9, 8.0)], "r string, c int, v double")
    wide = to_matrix(long, "r", "c", "v", [1, 2, 3])
    assert wide.columns == ["r", "1", "2", "3"]
    assert sorted(map(tuple, wide.collect())) == [("a", 5.0, 6.0, None), ("b", None, 7.0, None)]
    back = transposed(wide, "r", ["a", "b"], "c")
    assert sorted(map(tuple, back.collect())) == [("1", 5.0, None), ("2", 6.0, 7.0), ("3", None, None)]


def test_doubled_quotes_and_line_breaks(spark):
    d = scratch()
    _csv(d, "a.csv", HEAD + '"A ""x"", y","r",,oblast,2024-01-01 10:00:00,\n')
    r = files.read_alerts_csv(spark, d).collect()[0]
    assert (r.oblast, r.raion, r.level) == ('A "x", y', "r", "oblast")
    d = scratch()
    _csv(d, "a.csv", HEAD + '"A\nB",r,,oblast,2024-01-01 10:00:00,\n')
    assert files.read_alerts_csv(spark, d, multi_line=True).collect()[0].oblast == "A\nB"


def test_every_na_text_is_null_in_both_sources(spark):
    from spanwise.config import RAW_NULL_TOKENS
    d = scratch()
    _csv(d, "a.csv", HEAD + "".join(f"A,{t},,oblast,2024-01-01 10:00:00,{t}\n" for t in RAW_NULL_TOKENS))
    rows = files.read_alerts_csv(spark, d).collect()
    assert len(rows) == len(RAW_NULL_TOKENS) and all(r.raion is None and r.finished_at is None for r in rows)
    d = scratch()
    _csv(d, "b.csv", "region,started_at\nСумська,NaN\nСумська,2024-01-01 00:00:00\n")
    kept = reconcile.second_source(files.read_second_source_csv(spark, d), DEFAULT).collect()
    assert len(kept) == 1  # a missing start is dropped, it does not raise


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from spanwise import session
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_ingest_counts(spark):
    from spanwise.operators import clean
    rows = [("A", None, None, "oblast", s, f, src) for s, f, src in [
        ("2024-01-01 00:00:00", "2024-01-01 13:00:00", "a"), ("2024-01-01 00:00:00", "2024-01-01 13:00:00", "b"),
        ("bad", None, "a"), ("2024-01-01 00:00:00", "2024-01-01 12:00:00", "a"), (None, None, "a")]]
    raw = spark.createDataFrame(rows, "oblast string, raion string, hromada string, level string, started_at string, finished_at string, source string")
    assert clean.ingest_counts(raw, DEFAULT).first().asDict() == {"n_raw": 5, "n_distinct": 4, "n_bad_start": 2, "n_capped": 1}


POINT = {"type": "Point", "coordinates": [30.5, 50.25]}
MULTI = {"type": "MultiPolygon", "coordinates": [[[[0.5, 0.5], [1.5, 0.5], [1.5, 1.5], [0.5, 0.5]]], [[[3.5, 3.5], [4.5, 3.5], [4.5, 4.5], [3.5, 3.5]]]]}


def test_features_roundtrip(spark):
    d = scratch()
    src = os.path.join(d, "fc.json")
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"admin": "Ukraine", "name": "Kiev City", "name_uk": "Київ"}, "geometry": POINT},
        {"type": "Feature", "properties": {"admin": "Ukraine", "name": "Sumy", "name_uk": "Сумська область"}, "geometry": MULTI},
        {"type": "Feature", "properties": {"admin": "Ukraine", "name": "X", "name_uk": "Невідома"}, "geometry": None},
        {"type": "Feature", "properties": {"admin": "Poland", "name": "Y", "name_uk": "Y"}, "geometry": POINT},
    ]}
    with open(src, "w", encoding="utf-8") as fh:
        json.dump(fc, fh, ensure_ascii=False)
    feats = files.read_features(spark, src, DEFAULT)
    assert sorted(r.region for r in feats.collect()) == sorted(["м. Київ", "Сумська", "Невідома"])
    out = os.path.join(d, "out")
    files.write_features(feats, out)
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read() for f in os.listdir(out) if f.startswith("part-"))
    doc = json.loads(text)
    assert doc["type"] == "FeatureCollection" and len(doc["features"]) == 3
    assert all(f["id"] == f["properties"]["region"] for f in doc["features"])
    geometry = {f["id"]: f.get("geometry") for f in doc["features"]}
    assert geometry == {"м. Київ": POINT, "Сумська": MULTI, "Невідома": None}  # nested, as it came


def test_processed_table_sink(spark):
    d = scratch()
    df = spark.createDataFrame([("a", dt.datetime(2023, 5, 1), None, 2023), ("b", dt.datetime(2024, 5, 1), None, 2024)],
                               "region string, started_at timestamp_ntz, finished_at timestamp_ntz, year int")
    files.write_episodes(df, os.path.join(d, "eps"))
    assert {"year=2023", "year=2024"} <= set(os.listdir(os.path.join(d, "eps")))
    assert spark.read.parquet(os.path.join(d, "eps")).count() == 2


def eps_df(spark, rows):
    return spark.createDataFrame(rows, "region string, started_at timestamp_ntz, finished_at timestamp_ntz, duration_min double")


def test_quality_report_flags(spark):
    t = dt.datetime(2022, 3, 1)
    rows = [("Сумська", t, t, 0.0), ("Сумська", t + dt.timedelta(hours=2), t + dt.timedelta(hours=1), -60.0),
            ("Сумська", t + dt.timedelta(hours=2), t + dt.timedelta(hours=1), -60.0), ("Марс", t, None, None)]
    rep = {r.check: (r.severity, r.n_bad, r.passed) for r in quality.quality_report(eps_df(spark, rows), DEFAULT).collect()}
    assert rep["row_count"][2] is False
    assert rep["date_order"][1] == 2 and rep["negative_duration"][1] == 2
    assert rep["zero_duration"] == ("warn", 1, False)
    assert rep["duplicates"][1] == 1
    assert rep["unknown_regions"][1] == 1 and rep["missing_regions"][1] == 23
    assert rep["coverage_start"][1] == 4
    with pytest.raises(ValueError):
        quality.assert_valid(quality.quality_report(eps_df(spark, rows), DEFAULT))
    short = quality.quality_report(spark.createDataFrame([("Сумська",)], "region string"), DEFAULT)
    assert short.filter("check = 'schema'").first().n_bad == 3
    with pytest.raises(ValueError, match="schema=3"):
        quality.assert_valid(short)


def test_zero_duration_only_warns(spark):
    t = dt.datetime(2024, 3, 1)
    p = Profile(min_rows=1)
    rep = quality.quality_report(eps_df(spark, [("Сумська", t, t, 0.0)]), p)
    quality.assert_valid(rep)  # warnings never raise


def test_reconciliation(spark):
    p = Profile(excluded=("Луганська",))
    t = dt.datetime(2024, 1, 1)
    eps = eps_df(spark, [("Сумська", t, t, 0.0), ("Сумська", t, t, 0.0), ("Луганська", t, t, 0.0)])
    vol = spark.createDataFrame([("Сумська область", "2024-01-01 00:00:00+00:00"), ("Одеська", "2024-01-02 00:00:00+00:00"),
                                 ("Одеська", "2021-01-01 00:00:00+00:00")], "region string, started_at string")
    cmp = reconcile.compare_sources(eps, reconcile.second_source(vol, p), p).collect()
    assert [(r.region, r.official, r.volunteer, r.ratio_off_vol) for r in cmp] == [("Сумська", 2, 1, 2.0), ("Одеська", 0, 1, 0.0)]
    bad = spark.createDataFrame([("Сумська", "not a date")], "region string, started_at string")
    with pytest.raises(Exception):
        reconcile.second_source(bad, p).collect()


def test_unit_coverage_branches(spark):
    t = dt.datetime(2024, 1, 1, 10)
    h = dt.timedelta(hours=1)
    units = spark.createDataFrame([
        ("A", "A", "oblast", t, t + h),            # overlaps the closed episode
        ("A", "A::1", "raion", t + 2 * h, t + 3 * h),  # after it, touches nothing
        ("A", "A::2", "raion", t - 3 * h, None),     # open since before: covers closed episodes
        ("A", "A::3", "raion", t + 5 * h, t + 6 * h),  # starts after the open episode start
    ], "region string, unit_name string, level string, started_at timestamp_ntz, finished_at timestamp_ntz")
    eps = eps_df(spark, [("A", t, t + h, 60.0), ("A", t + 4 * h, None, None), ("B", t, t + h, 60.0)])
    got = {(r.region, r.started_at): (r.unit_count, r.unit_fraction)
           for r in coverage.episode_unit_coverage(units, eps).collect()}
    assert got[("A", t)] == (2, 0.5)
    assert got[("A", t + 4 * h)] == (1, 0.25)
    assert got[("B", t)] == (0, 0.0)


def test_entry_smoke(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert df.count() > 0
    assert set(se.oracle_sql()) <= set(se.queries())
