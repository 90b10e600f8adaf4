"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, reads the driver's tables (whole
tables, no sampling) and returns a DataFrame.  Building runs jobs where a step
writes an intermediate table or reads one-row bounds; the query itself is lazy.
Column names are identical in the Spark result and the SQL text.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.config import DOW_LONG, DOW_SHORT
from spanwise.functions.matrix import to_matrix
from spanwise.functions.stored import drop_table, input_version, write_table
from spanwise.operators import (clean, coverage, cross_region, describe, quality, reconcile, seasonal, shape,
                                survival, temporal, unify)
from spanwise.plans import pipeline
from spanwise.plans.oracle import with_pipeline
from spanwise.session import ensure_checkpoint_dir
from spanwise.sources import files
from spanwise.sources.binding import (binding_profile, features_from_nations, intervals_from_orders, raw_alerts_from_events,
                                      second_source_from_events)
from spanwise.sources.binding import FEATURES_SQL, ORDERS_SQL

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, with_pipeline(sql) if sql is not None else None)
        return fn
    return deco


# ---- shared inputs ------------------------------------------------------------

PROFILE = binding_profile()


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.null_tokens(clean.normalise_headers(raw_alerts_from_events(pipeline.read_table(spark, sf_dir, "events"))))


_TABLES: dict[tuple, tuple[tuple, DataFrame]] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build once per application, data directory and version of the input, keep as a written table.

    Mirrors a deployment: the ingest (unit records, analysis frame) is written once
    and every analytic reads the table, instead of re-running the ingest per query.
    """
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    version = input_version(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    if key in _TABLES and _TABLES[key][0] != version:
        drop_table(_TABLES.pop(key)[1])  # the input was replaced
    if key not in _TABLES:
        _TABLES[key] = (version, write_table(build(), name))
    return _TABLES[key][1]


def waves_table(spark, sf_dir) -> DataFrame:
    return _stored(spark, sf_dir, "waves", lambda: cross_region.waves(frame(spark, sf_dir), 5, 3.0, PROFILE.tz))


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/spanwise-files/{name}-{uuid.uuid4().hex}"


COUNTERS = ["n_raw", "n_distinct", "n_bad_start", "n_capped"]
_COUNTS: dict[tuple, dict[str, int]] = {}


def units_plan(spark, sf_dir) -> DataFrame:
    counts = _COUNTS[spark.sparkContext.applicationId, sf_dir.rstrip("/")] = {}
    return pipeline.unit_records(raw(spark, sf_dir), PROFILE, report=counts)


def units(spark, sf_dir) -> DataFrame:
    return _stored(spark, sf_dir, "units", lambda: units_plan(spark, sf_dir))


def episodes_plan(spark, sf_dir) -> DataFrame:
    return pipeline.episodes_from_units(units(spark, sf_dir))


def episodes(spark, sf_dir) -> DataFrame:
    return _stored(spark, sf_dir, "episodes", lambda: episodes_plan(spark, sf_dir))


def frame(spark, sf_dir) -> DataFrame:
    return _stored(spark, sf_dir, "frame", lambda: pipeline.analysis_frame(episodes(spark, sf_dir), PROFILE))


RECORD_COLS = "oblast, raion, hromada, level, started_at, finished_at"


# ---- file sources ---------------------------------------------------------------

@register("scan_alerts", """
SELECT oblast, raion, hromada, level, started_at, finished_at, source FROM raw""")
def q_scan_alerts(spark, sf_dir):
    path = _scratch(spark, "alerts")
    files.write_csv(raw_alerts_from_events(pipeline.read_table(spark, sf_dir, "events")), path)
    return files.read_alerts_csv(spark, path)


@register("scan_alerts_by_name", """
SELECT oblast, raion, hromada, level, started_at, finished_at FROM raw""")
def q_scan_by_name(spark, sf_dir):
    """One folder of files whose columns come in three orders, one without the optional column."""
    path = _scratch(spark, "alerts-mixed")
    rows = raw_alerts_from_events(pipeline.read_table(spark, sf_dir, "events"))
    third = F.pmod(F.xxhash64(*rows.columns), F.lit(3))
    for i, columns in enumerate((rows.columns, rows.columns[::-1], [c for c in rows.columns[2:] + rows.columns[:2] if c != "source"])):
        files.write_csv(rows.where(third == i).select(*columns), path, mode="append")
    return files.read_alerts_csv(spark, path).select(*clean.RAW_KEY)


@register("feature_dimension", f"""
, f AS ({FEATURES_SQL})
SELECT coalesce(CASE name WHEN 'Kiev' THEN 'Київська' WHEN 'Kiev City' THEN 'м. Київ' END, a.canonical, name_uk) AS region,
       name_uk, name AS name_en, geo_type, lon, lat
FROM f LEFT JOIN alias_map a ON a.variant = f.name_uk WHERE admin = 'Ukraine'""")
def q_feature_dimension(spark, sf_dir):
    path = _scratch(spark, "features")
    doc = features_from_nations(pipeline.read_table(spark, sf_dir, "nation"))
    doc.write.mode("overwrite").text(path)
    f = files.read_features(spark, path, PROFILE)
    part = lambda p, t: F.variant_get("geometry", p, t)
    return f.select("region", "name_uk", "name_en", part("$.type", "string").alias("geo_type"),
                    part("$.coordinates[0]", "double").alias("lon"), part("$.coordinates[1]", "double").alias("lat"))


@register("feature_sink", f"""
, f AS ({FEATURES_SQL}),
r AS (SELECT coalesce(CASE name WHEN 'Kiev' THEN 'Київська' WHEN 'Kiev City' THEN 'м. Київ' END, a.canonical, name_uk) AS region, f.*
      FROM f LEFT JOIN alias_map a ON a.variant = f.name_uk WHERE admin = 'Ukraine')
SELECT region AS id, name AS name_en, geo_type, lon FROM r""")
def q_feature_sink(spark, sf_dir):
    source, path = _scratch(spark, "features"), _scratch(spark, "features-out")
    features_from_nations(pipeline.read_table(spark, sf_dir, "nation")).write.mode("overwrite").text(source)
    files.write_features(files.read_features(spark, source, PROFILE), path)
    f = spark.read.option("multiLine", True).schema(files.FEATURE_SCHEMA).json(path).select(F.explode("features").alias("f")).select("f.*")
    return f.select("id", F.col("properties")["name_en"].alias("name_en"), F.variant_get("geometry", "$.type", "string").alias("geo_type"),
                    F.variant_get("geometry", "$.coordinates[0]", "double").alias("lon"))


# ---- ingest -------------------------------------------------------------------

@register("ingest_counts", """
, g AS (SELECT oblast, raion, hromada, level, started_at, finished_at, count(*) AS copies FROM raw GROUP BY ALL),
p AS (SELECT copies, TRY_CAST(started_at AS TIMESTAMPTZ) AS s, TRY_CAST(finished_at AS TIMESTAMPTZ) AS e FROM g)
SELECT CAST(sum(copies) AS BIGINT) AS n_raw, count(*) AS n_distinct, count(*) FILTER (WHERE s IS NULL) AS n_bad_start,
       count(*) FILTER (WHERE e - s > INTERVAL 3 HOUR) AS n_capped FROM p""")
def q_ingest_counts(spark, sf_dir):
    """Counters of the load that wrote the unit table: no pass of their own over the raw rows."""
    units(spark, sf_dir)
    counts = _COUNTS[spark.sparkContext.applicationId, sf_dir.rstrip("/")]
    return spark.createDataFrame([tuple(counts[c] for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))


@register("dedup_alerts", f"SELECT {RECORD_COLS} FROM dedup")
def q_dedup(spark, sf_dir):
    return clean.dedup_raw(raw(spark, sf_dir)).select(*clean.RAW_KEY)


@register("parse_alerts", f"SELECT {RECORD_COLS} FROM capped")
def q_parse(spark, sf_dir):
    return clean.prepare_records(raw(spark, sf_dir), PROFILE).select(*clean.RAW_KEY)


@register("level_split", """
SELECT CASE WHEN level IN ('oblast', 'raion') THEN 'base' ELSE 'fine' END AS part, level, count(*) AS n
FROM capped WHERE level IN ('oblast', 'raion', 'hromada') GROUP BY 1, 2""")
def q_level_split(spark, sf_dir):
    base, fine = clean.split_levels(clean.prepare_records(raw(spark, sf_dir), PROFILE))
    tag = lambda d, name: d.groupBy("level").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "level", "n")
    return tag(base, "base").unionByName(tag(fine, "fine"))


@register("uncovered_fine", f"SELECT {RECORD_COLS} FROM uncovered")
def q_uncovered(spark, sf_dir):
    base, fine = clean.split_levels(clean.prepare_records(raw(spark, sf_dir), PROFILE))
    return unify.uncovered_fine(fine, base, PROFILE.cap_seconds).select(*clean.RAW_KEY)


@register("canonical_region", "SELECT oblast, region, count(*) AS n FROM units_all GROUP BY 1, 2")
def q_canonical(spark, sf_dir):
    records = clean.prepare_records(raw(spark, sf_dir), PROFILE)
    base, fine = clean.split_levels(records)
    u = base.unionByName(unify.uncovered_fine(fine, base, PROFILE.cap_seconds).select(*base.columns))
    return clean.canonical_region(u, PROFILE.aliases).groupBy("oblast", "region").agg(F.count(F.lit(1)).alias("n"))


@register("unit_records", "SELECT region, unit_name, level, started_at, finished_at FROM units")
def q_units(spark, sf_dir):
    return pipeline.unit_projection(units_plan(spark, sf_dir))


@register("exclude_regions", "SELECT region, count(*) AS n FROM units GROUP BY region")
def q_exclude(spark, sf_dir):
    return units(spark, sf_dir).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@register("episodes", "SELECT region, started_at, finished_at, duration_min FROM episodes_d")
def q_episodes(spark, sf_dir):
    return episodes_plan(spark, sf_dir)


@register("episodes_ordered", """
SELECT row_number() OVER (ORDER BY started_at, region, finished_at NULLS LAST) AS position, region, started_at, finished_at FROM episodes_d""")
def q_ordered(spark, sf_dir):
    return unify.in_start_order(episodes(spark, sf_dir)).select("position", "region", "started_at", "finished_at")


@register("processed_table", "SELECT region, started_at, finished_at, duration_min, year FROM af")
def q_processed(spark, sf_dir):
    path = _scratch(spark, "processed")
    files.write_episodes(frame(spark, sf_dir), path)
    return spark.read.parquet(path).select("region", "started_at", "finished_at", "duration_min", "year")


@register("episode_records", "SELECT region, started_at, n_records FROM episodes")
def q_episode_records(spark, sf_dir):
    u = units(spark, sf_dir).select("region", "started_at", "finished_at")
    return unify.merge_intervals(u, with_count=True).select("region", "started_at", "n_records")


@register("prepared", """
SELECT region, started_at, finished_at, duration_min, censored, local_start, hour, dow, dow_name,
       month, month_name, year, date, week FROM af""")
def q_prepared(spark, sf_dir):
    return frame(spark, sf_dir)


@register("filter_region_date", """
SELECT region, started_at, finished_at, duration_min FROM af
WHERE region IN ('R01', 'R02', 'R03') AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def q_filter(spark, sf_dir):
    f = clean.filter_region_date(frame(spark, sf_dir), ["R01", "R02", "R03"], "2024-01-05", "2024-01-20")
    return f.select("region", "started_at", "finished_at", "duration_min")


# orders carry seven years of dates, so the local-time rules see both DST changes
ORDERS_LOCAL_SQL = """
SELECT o_orderkey,
       timezone('Europe/Kyiv', timezone('UTC', o_orderdate)) AS local_ts,
       CAST(hour(timezone('Europe/Kyiv', timezone('UTC', o_orderdate))) AS INTEGER) AS hour,
       CAST(CAST(timezone('Europe/Kyiv', timezone('UTC', o_orderdate)) AS DATE) AS DATE) AS date,
       CAST(floor(date_diff('microsecond',
             timezone('UTC', timezone('Europe/Kyiv', TIMESTAMP '2022-02-24 00:00:00')) ,
             o_orderdate) / 86400000000.0) AS BIGINT) AS ndays
FROM orders"""


@register("local_time", ORDERS_LOCAL_SQL)
def q_local_time(spark, sf_dir):
    o = pipeline.read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("started_at"))
    o = temporal.local_time(o, PROFILE.tz, out="local_ts")
    o = temporal.days_since_start(o, PROFILE)
    return o.select(
        "o_orderkey", "local_ts", F.hour("local_ts").alias("hour"), F.to_date("local_ts").alias("date"), "ndays"
    )


@register("days_since_start", """
SELECT region, started_at,
       CAST(floor(date_diff('microsecond',
             timezone('UTC', timezone('Europe/Kyiv', TIMESTAMP '2022-02-24 00:00:00')),
             started_at) / 86400000000.0) AS BIGINT) AS ndays
FROM af""")
def q_days_since(spark, sf_dir):
    return temporal.days_since_start(frame(spark, sf_dir), PROFILE).select("region", "started_at", "ndays")


@register("binary_series", """
, bnd AS (
  SELECT min(floor(epoch_us(started_at) / 3600000000.0)) AS lo,
         greatest(max(ceil(epoch_us(finished_at) / 3600000000.0)),
                  max(CASE WHEN finished_at IS NULL THEN ceil(epoch_us(started_at) / 3600000000.0) + 1 END)) AS hi
  FROM af),
cells AS (
  SELECT DISTINCT region, b FROM (
    SELECT region, unnest(generate_series(
      CAST(floor(epoch_us(started_at) / 3600000000.0) AS BIGINT),
      CAST(coalesce(ceil(epoch_us(finished_at) / 3600000000.0), (SELECT hi FROM bnd)) AS BIGINT) - 1)) AS b
    FROM af WHERE region IS NOT NULL)),
regs AS (SELECT DISTINCT region FROM af WHERE region IS NOT NULL),
grid AS (SELECT region, unnest(generate_series(CAST((SELECT lo FROM bnd) AS BIGINT), CAST((SELECT hi FROM bnd) AS BIGINT))) AS b FROM regs)
SELECT make_timestamp(g.b * 3600000000) AS bucket, g.region,
       CASE WHEN c.b IS NULL THEN 0 ELSE 1 END AS active
FROM grid g LEFT JOIN cells c ON c.region = g.region AND c.b = g.b""")
def q_binary(spark, sf_dir):
    return temporal.binary_series(frame(spark, sf_dir), 3600)


# ---- descriptive --------------------------------------------------------------

def _freq_sql(period_expr: str, step: str, spine_lo: str, spine_hi: str, label: str = "p") -> str:
    return f"""
, c AS (SELECT {period_expr} AS period, count(*) AS alert_count FROM af GROUP BY 1),
spine AS (SELECT unnest(generate_series({spine_lo}, {spine_hi}, {step})) AS p FROM (SELECT min(period) AS lo, max(period) AS hi FROM c) WHERE lo IS NOT NULL)
SELECT CAST({label} AS DATE) AS period, coalesce(c.alert_count, 0) AS alert_count
FROM spine LEFT JOIN c ON c.period = CAST({label} AS DATE)"""


@register("freq_daily", _freq_sql("date", "INTERVAL 1 DAY", "CAST(lo AS TIMESTAMP)", "CAST(hi AS TIMESTAMP)"))
def q_freq_daily(spark, sf_dir):
    return describe.frequency_over_time(frame(spark, sf_dir), "D")


@register("freq_weekly", _freq_sql("CAST(date + CAST(7 - isodow(date) AS INTEGER) AS DATE)", "INTERVAL 7 DAY",
                                   "CAST(lo AS TIMESTAMP)", "CAST(hi AS TIMESTAMP)"))
def q_freq_weekly(spark, sf_dir):
    return describe.frequency_over_time(frame(spark, sf_dir), "W")


@register("freq_monthly", _freq_sql("last_day(date)", "INTERVAL 1 MONTH", "CAST(date_trunc('month', lo) AS TIMESTAMP)",
                                    "CAST(date_trunc('month', hi) AS TIMESTAMP)", label="last_day(p)"))
def q_freq_monthly(spark, sf_dir):
    return describe.frequency_over_time(frame(spark, sf_dir), "ME")


@register("duration_stats", """
, d AS (SELECT duration_min AS v FROM af WHERE NOT coalesce(censored, false) AND duration_min IS NOT NULL)
SELECT count(v) AS count, round_even(avg(v), 6) AS mean_min, round_even(quantile_cont(v, 0.5), 6) AS median_min,
       round_even(quantile_cont(v, 0.25), 6) AS p25_min, round_even(quantile_cont(v, 0.75), 6) AS p75_min,
       round_even(quantile_cont(v, 0.95), 6) AS p95_min, round_even(max(v), 6) AS max_min,
       round_even(stddev_samp(v), 6) AS std_min, round_even(sum(v) / 60.0, 6) AS total_hours
FROM d HAVING count(v) > 0""")
def q_duration_stats(spark, sf_dir):
    return describe.duration_stats(frame(spark, sf_dir))


@register("duration_hist", """
, d AS (SELECT duration_min AS v FROM af WHERE NOT coalesce(censored, false) AND duration_min IS NOT NULL),
tot AS (SELECT count(*) AS n_total, count(*) FILTER (WHERE v > 300.0) AS n_excluded FROM d),
b0 AS (SELECT v, CAST(least(floor(v * (60 / 300.0)), 59) AS INTEGER) AS i FROM d WHERE v >= 0 AND v <= 300.0),
b1 AS (SELECT v, CASE WHEN v < i * 5.0 THEN i - 1 ELSE i END AS i FROM b0),
b2 AS (SELECT CASE WHEN v >= (CASE WHEN i + 1 >= 60 THEN 300.0 ELSE (i + 1) * 5.0 END) AND i != 59 THEN i + 1 ELSE i END AS i FROM b1),
cnt AS (SELECT i AS bin, count(*) AS count FROM b2 GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(0, 59)) AS INTEGER) AS bin)
SELECT s.bin, s.bin * 5.0 AS bin_left,
       CASE WHEN s.bin + 1 >= 60 THEN 300.0 ELSE (s.bin + 1) * 5.0 END AS bin_right,
       (s.bin * 5.0 + CASE WHEN s.bin + 1 >= 60 THEN 300.0 ELSE (s.bin + 1) * 5.0 END) / 2 AS bin_mid,
       CASE WHEN s.bin + 1 >= 60 THEN 300.0 ELSE (s.bin + 1) * 5.0 END - s.bin * 5.0 AS bin_width,
       coalesce(c.count, 0) AS count, tot.n_total, tot.n_excluded,
       CASE WHEN tot.n_total = 0 THEN NULL ELSE tot.n_excluded / tot.n_total END AS excluded_share
FROM spine s LEFT JOIN cnt c ON c.bin = s.bin, tot""")
def q_duration_hist(spark, sf_dir):
    return describe.duration_histogram(frame(spark, sf_dir), 300.0, 60)


@register("regional_breakdown", """
SELECT region, count(started_at) AS alert_count, round_even(avg(duration_min), 1) AS mean_duration_min,
       round_even(sum(duration_min) / 60.0, 1) AS total_duration_h
FROM af WHERE region IS NOT NULL GROUP BY region""")
def q_regional(spark, sf_dir):
    return describe.regional_breakdown(frame(spark, sf_dir))


@register("region_drill_down", """
SELECT region, count(started_at) AS alert_count, round_even(avg(duration_min), 1) AS mean_duration_min,
       round_even(sum(duration_min) / 60.0, 1) AS total_duration_h
FROM af WHERE region = 'R07' GROUP BY region""")
def q_drill_down(spark, sf_dir):
    return describe.regional_breakdown(clean.filter_region_date(frame(spark, sf_dir), ["R07"]))


@register("top_days", """
SELECT date, count(*) AS alert_count, CAST(row_number() OVER (ORDER BY count(*) DESC, date) AS INTEGER) AS rank FROM af GROUP BY date""")
def q_top_days(spark, sf_dir):
    return describe.top_days(frame(spark, sf_dir))


@register("cumulative_daily", """
, c AS (SELECT date, count(*) AS n FROM af GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM c),
d AS (SELECT s.date, coalesce(c.n, 0) AS daily_count FROM spine s LEFT JOIN c ON c.date = s.date)
SELECT date, daily_count, sum(daily_count) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative FROM d""")
def q_cumulative(spark, sf_dir):
    return describe.cumulative_daily(frame(spark, sf_dir))


@register("header_metrics", """
SELECT count(*) AS n_episodes, count(DISTINCT region) AS n_regions,
       round_even(quantile_cont(CASE WHEN NOT coalesce(censored, false) THEN duration_min END, 0.5), 6) AS median_duration_min,
       round_even(sum(CASE WHEN NOT coalesce(censored, false) THEN duration_min END) / 60.0, 6) AS total_hours,
       min(started_at) AS first_start, max(started_at) AS last_start
FROM af""")
def q_header(spark, sf_dir):
    return describe.header_metrics(frame(spark, sf_dir))


# ---- seasonality --------------------------------------------------------------

@register("hour_dow", """
, c AS (SELECT hour, dow, count(*) AS n FROM af GROUP BY 1, 2),
w AS (SELECT greatest(1.0, floor(date_diff('microsecond', min(started_at), max(started_at)) / 86400000000.0) / 7.0) AS n_weeks
      FROM af HAVING count(*) > 0),
g AS (SELECT n_weeks, h.hour, d.dow FROM w,
      (SELECT CAST(unnest(generate_series(0, 23)) AS INTEGER) AS hour) h,
      (SELECT CAST(unnest(generate_series(0, 6)) AS INTEGER) AS dow) d)
SELECT g.hour, g.dow, ['Пн', 'Вт', 'Ср', 'Чт', 'Пт', 'Сб', 'Нд'][g.dow + 1] AS dow_short,
       round_even(coalesce(c.n, 0) / g.n_weeks, 2) AS rate
FROM g LEFT JOIN c ON c.hour = g.hour AND c.dow = g.dow""")
def q_hour_dow(spark, sf_dir):
    return seasonal.hour_dow_rate(frame(spark, sf_dir))


_HOUR_DOW = REGISTRY["hour_dow"][1]


def _wide(long_sql: str, row: str, column: str, value: str, cells: list[tuple[str, str]]) -> str:
    """SQL of a matrix: a column per (SQL literal, name)."""
    picks = ", ".join(f'max(CASE WHEN {column} = {v} THEN {value} END) AS "{n}"' for v, n in cells)
    return f"SELECT {row}, {picks} FROM ({long_sql}) GROUP BY {row}"


@register("hour_dow_matrix", None)
def q_hour_dow_matrix(spark, sf_dir):
    return to_matrix(seasonal.hour_dow_rate(frame(spark, sf_dir)), "hour", "dow", "rate", range(7), lambda d: DOW_SHORT[d])


REGISTRY["hour_dow_matrix"] = (q_hour_dow_matrix, _wide(_HOUR_DOW, "hour", "dow", "rate", [(str(i), n) for i, n in enumerate(DOW_SHORT)]))


@register("year_month", """
, c AS (SELECT year, month, count(*) AS n FROM af GROUP BY 1, 2),
g AS (SELECT y.year, CAST(unnest(generate_series(1, 12)) AS INTEGER) AS month FROM (SELECT DISTINCT year FROM af) y)
SELECT g.year, g.month, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON c.year = g.year AND c.month = g.month""")
def q_year_month(spark, sf_dir):
    return seasonal.year_month_counts(frame(spark, sf_dir))


@register("year_month_matrix", None)
def q_year_month_matrix(spark, sf_dir):
    return to_matrix(seasonal.year_month_counts(frame(spark, sf_dir)), "year", "month", "n", range(1, 13))


REGISTRY["year_month_matrix"] = (q_year_month_matrix, _wide(REGISTRY["year_month"][1], "year", "month", "n", [(str(i), str(i)) for i in range(1, 13)]))
MATRIX_REGIONS = [r for r in PROFILE.region_names if r not in PROFILE.excluded]


_HOUR_REGION = """
, c AS (SELECT hour, region, count(*) AS n FROM af WHERE region IS NOT NULL GROUP BY 1, 2),
g AS (SELECT r.region, h.hour FROM (SELECT DISTINCT region FROM af WHERE region IS NOT NULL) r,
      (SELECT DISTINCT hour FROM af WHERE region IS NOT NULL) h),
x AS (SELECT g.hour, g.region, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON c.hour = g.hour AND c.region = g.region)
"""


@register("hour_region", _HOUR_REGION + "SELECT hour, region, n FROM x")
def q_hour_region(spark, sf_dir):
    return seasonal.hour_region(frame(spark, sf_dir))


@register("hour_region_matrix", None)
def q_hour_region_matrix(spark, sf_dir):
    return to_matrix(seasonal.hour_region(frame(spark, sf_dir)), "hour", "region", "n", MATRIX_REGIONS)


_REGION_CELLS = [(f"'{r}'", r) for r in MATRIX_REGIONS]
REGISTRY["hour_region_matrix"] = (q_hour_region_matrix, _wide(REGISTRY["hour_region"][1], "hour", "region", "n", _REGION_CELLS))


@register("hour_region_share", _HOUR_REGION + """
SELECT hour, region, n / CASE WHEN sum(n) OVER (PARTITION BY region) = 0 THEN 1 ELSE sum(n) OVER (PARTITION BY region) END AS share FROM x""")
def q_hour_region_share(spark, sf_dir):
    return seasonal.hour_region(frame(spark, sf_dir), normalize=True)


@register("duration_by_hour", """
SELECT hour, round_even(avg(duration_min), 1) AS mean_duration_min FROM af WHERE NOT coalesce(censored, false) GROUP BY hour""")
def q_duration_by_hour(spark, sf_dir):
    return seasonal.duration_by_hour(frame(spark, sf_dir))


@register("night_ratio", """
SELECT count(*) FILTER (WHERE hour >= 20 OR hour < 6) AS night_count,
       count(*) - count(*) FILTER (WHERE hour >= 20 OR hour < 6) AS day_count,
       count(*) FILTER (WHERE hour >= 20 OR hour < 6) / greatest(count(*), 1) AS night_fraction
FROM af""")
def q_night(spark, sf_dir):
    return seasonal.night_ratio(frame(spark, sf_dir))


@register("rolling_7d", """
, c AS (SELECT date, count(*) AS n FROM af GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM c),
d AS (SELECT s.date, coalesce(c.n, 0) AS count FROM spine s LEFT JOIN c ON c.date = s.date)
SELECT date, count,
       CASE WHEN count(*) OVER w = 7 THEN round_even(avg(count) OVER w, 1) END AS rolling_7d
FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def q_rolling(spark, sf_dir):
    return seasonal.rolling_7d(frame(spark, sf_dir))


# ---- cross-region -------------------------------------------------------------

_STARTS = """
, s AS (SELECT region, started_at, epoch_us(started_at) AS us, row_number() OVER () AS id
        FROM af WHERE region IS NOT NULL AND started_at IS NOT NULL)
"""


@register("co_occurrence", _STARTS + """
, n AS (SELECT region, count(*) AS n FROM s GROUP BY 1),
h AS (SELECT x.region AS a, y.region AS b, count(DISTINCT x.id) AS h FROM s x JOIN s y
      ON y.region <> x.region AND y.us BETWEEN x.us - 7200000000 AND x.us + 7200000000 GROUP BY 1, 2),
m AS (SELECT p.region AS region_a, q.region AS region_b, coalesce(h.h, 0) / p.n AS m
      FROM n p JOIN n q ON true LEFT JOIN h ON h.a = p.region AND h.b = q.region)
SELECT m1.region_a, m1.region_b,
       CASE WHEN m1.region_a = m1.region_b THEN NULL ELSE (m1.m + m2.m) / 2.0 END AS value
FROM m m1 JOIN m m2 ON m1.region_a = m2.region_b AND m1.region_b = m2.region_a""")
def q_cooc(spark, sf_dir):
    return cross_region.co_occurrence(frame(spark, sf_dir), 2.0)


_DENSE = """
, bnd AS (
  SELECT min(floor(epoch_us(started_at) / 3600000000.0)) AS lo,
         greatest(max(ceil(epoch_us(finished_at) / 3600000000.0)),
                  max(CASE WHEN finished_at IS NULL THEN ceil(epoch_us(started_at) / 3600000000.0) + 1 END)) AS hi
  FROM af),
cells AS (
  SELECT DISTINCT region, b FROM (
    SELECT region, unnest(generate_series(
      CAST(floor(epoch_us(started_at) / 3600000000.0) AS BIGINT),
      CAST(coalesce(ceil(epoch_us(finished_at) / 3600000000.0), (SELECT hi FROM bnd)) AS BIGINT) - 1)) AS b
    FROM af WHERE region IS NOT NULL)),
regs AS (SELECT DISTINCT region FROM af WHERE region IS NOT NULL),
grid AS (SELECT region, unnest(generate_series(CAST((SELECT lo FROM bnd) AS BIGINT), CAST((SELECT hi FROM bnd) AS BIGINT))) AS b FROM regs),
dense AS (SELECT g.region, g.b, CASE WHEN c.b IS NULL THEN 0 ELSE 1 END AS active
          FROM grid g LEFT JOIN cells c ON c.region = g.region AND c.b = g.b)
"""


@register("lag_correlation", _DENSE + """
, lags AS (SELECT CAST(unnest(generate_series(-6, 6)) AS INTEGER) AS lag),
pr AS (SELECT x.region AS region_a, y.region AS region_b, l.lag,
              CAST(count(*) AS DOUBLE) AS n, CAST(sum(x.active) AS DOUBLE) AS sx, CAST(sum(y.active) AS DOUBLE) AS sy,
              CAST(sum(x.active * y.active) AS DOUBLE) AS sxy
       FROM dense x JOIN lags l ON true JOIN dense y ON y.b = x.b - l.lag AND y.region <> x.region
       GROUP BY 1, 2, 3),
r AS (SELECT *, n * sxy - sx * sy AS num, sqrt((n * sx - sx * sx) * (n * sy - sy * sy)) AS den FROM pr)
SELECT region_a, region_b, lag AS lag_hours, round_even(CASE WHEN den > 0 THEN num / den END, 4) + 0.0 AS correlation FROM r""")
def q_lag_corr(spark, sf_dir):
    return cross_region.lag_correlation(frame(spark, sf_dir), 6)


_DAILY = """
, dd AS (SELECT DISTINCT date FROM af WHERE region IS NOT NULL),
rr AS (SELECT DISTINCT region FROM af WHERE region IS NOT NULL),
cc AS (SELECT date, region, count(*) AS n FROM af WHERE region IS NOT NULL GROUP BY 1, 2),
g AS (SELECT dd.date, rr.region, CAST(coalesce(cc.n, 0) AS DOUBLE) AS x
      FROM dd JOIN rr ON true LEFT JOIN cc ON cc.date = dd.date AND cc.region = rr.region)
"""

_PEARSON_SELECT = """
, pr AS (SELECT a.region AS region_a, b.region AS region_b, CAST(count(*) AS DOUBLE) AS n,
                sum(a.x) AS sx, sum(b.x) AS sy, sum(a.x * a.x) AS sxx, sum(b.x * b.x) AS syy, sum(a.x * b.x) AS sxy
         FROM {src} a JOIN {src} b ON a.date = b.date GROUP BY 1, 2),
r AS (SELECT *, n * sxy - sx * sy AS num, sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS den FROM pr)
SELECT region_a, region_b, round_even(CASE WHEN den > 0 THEN num / den END, 3) + 0.0 AS value FROM r"""


@register("lag_correlation_pair", _DENSE + """
, lags AS (SELECT CAST(unnest(generate_series(-6, 6)) AS INTEGER) AS lag),
pr AS (SELECT x.region AS region_a, y.region AS region_b, l.lag, corr(x.active, y.active) AS r, stddev_pop(x.active) AS da, stddev_pop(y.active) AS db
       FROM dense x JOIN lags l ON true JOIN dense y ON y.b = x.b - l.lag
       WHERE x.region = 'R03' AND y.region = 'R11' GROUP BY 1, 2, 3)
SELECT region_a, region_b, lag AS lag_hours, round_even(CASE WHEN da > 0 AND db > 0 THEN r END, 4) + 0.0 AS correlation FROM pr""")
def q_lag_pair(spark, sf_dir):
    return cross_region.lag_correlation(frame(spark, sf_dir), 6, region_a="R03", region_b="R11")


@register("corr_spearman", _DAILY + """
, rk AS (SELECT date, region, rank() OVER (PARTITION BY region ORDER BY x)
                + (count(*) OVER (PARTITION BY region, x) - 1) / 2.0 AS x FROM g)
""" + _PEARSON_SELECT.format(src="rk"))
def q_spearman(spark, sf_dir):
    return cross_region.rank_correlation(frame(spark, sf_dir), "spearman")


@register("corr_spearman_matrix", None)
def q_spearman_matrix(spark, sf_dir):
    """The region x region matrix as its readers get it: a row and a column per region of the dimension."""
    return to_matrix(cross_region.rank_correlation(frame(spark, sf_dir), "spearman"), "region_a", "region_b", "value", MATRIX_REGIONS)


REGISTRY["corr_spearman_matrix"] = (q_spearman_matrix, _wide(REGISTRY["corr_spearman"][1], "region_a", "region_b", "value", _REGION_CELLS))


@register("corr_pearson", _DAILY + _PEARSON_SELECT.format(src="g"))
def q_pearson(spark, sf_dir):
    return cross_region.rank_correlation(frame(spark, sf_dir), "pearson")


@register("corr_kendall", _DAILY + """
, df AS (SELECT x1.region, x1.date AS d1, x2.date AS d2, sign(x2.x - x1.x) AS sg
         FROM g x1 JOIN g x2 ON x1.region = x2.region AND x1.date < x2.date),
k AS (SELECT a.region AS region_a, b.region AS region_b, sum(a.sg * b.sg) AS s,
             CAST(count(*) FILTER (WHERE a.sg <> 0) AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE b.sg <> 0) AS DOUBLE) AS nb
      FROM df a JOIN df b ON a.d1 = b.d1 AND a.d2 = b.d2 GROUP BY 1, 2)
SELECT region_a, region_b, CASE WHEN region_a = region_b THEN 1.0
       ELSE round_even(CASE WHEN sqrt(na * nb) > 0 THEN s / sqrt(na * nb) END, 3) + 0.0 END AS value FROM k""")
def q_kendall(spark, sf_dir):
    return cross_region.rank_correlation(frame(spark, sf_dir), "kendall")


_WAVES = _STARTS + """
, tt AS (SELECT DISTINCT us AS t FROM s),
cand AS (SELECT tt.t FROM tt JOIN s ON s.us BETWEEN tt.t AND tt.t + 10800000000
         GROUP BY tt.t HAVING count(DISTINCT s.region) >= 5),
chain AS (
  WITH RECURSIVE ch(t) AS (
    SELECT min(t) FROM cand
    UNION ALL
    SELECT (SELECT min(c.t) FROM cand c WHERE c.t > ch.t + 10800000000) FROM ch WHERE ch.t IS NOT NULL)
  SELECT t FROM ch WHERE t IS NOT NULL),
mem AS (SELECT chain.t, s.region, min(s.started_at) AS started_at
        FROM chain JOIN s ON s.us BETWEEN chain.t AND chain.t + 10800000000 GROUP BY 1, 2),
wv AS (SELECT t, min(started_at) AS wave_start, max(started_at) AS last_start, count(*) AS regions_hit,
              arg_min(region, (started_at, region)) AS first_region,
              list({'region': region, 'started_at': started_at} ORDER BY started_at, region) AS sequence
       FROM mem GROUP BY t),
waves AS (SELECT CAST(row_number() OVER (ORDER BY regions_hit DESC, wave_start) AS INTEGER) AS rank, wave_start, strftime(timezone('Europe/Kyiv', timezone('UTC', wave_start)), '%Y-%m-%d') AS date,
                 first_region, CAST(regions_hit AS INTEGER) AS regions_hit,
                 round_even(date_diff('microsecond', wave_start, last_start) / 3600000000.0, 2) AS duration_h, sequence
          FROM wv)
"""


@register("waves", _WAVES + "SELECT * FROM waves")
def q_waves(spark, sf_dir):
    return waves_table(spark, sf_dir)


@register("wave_sequence", _WAVES + """
SELECT wave_start, CAST(p.pos - 1 AS INTEGER) AS position, p.item.region AS region, p.item.started_at AS started_at
FROM waves, LATERAL (SELECT unnest(sequence) AS item, generate_subscripts(sequence, 1) AS pos) p""")
def q_wave_sequence(spark, sf_dir):
    return cross_region.wave_sequence(waves_table(spark, sf_dir))


@register("wave_detail", _WAVES + """
, top AS (SELECT *, CAST(row_number() OVER (ORDER BY date DESC, regions_hit DESC, wave_start) AS INTEGER) AS list_position FROM waves)
SELECT list_position, wave_start, CAST(p.pos - 1 AS INTEGER) AS position, p.item.region AS region, p.item.started_at AS started_at,
       round_even(date_diff('microsecond', wave_start, p.item.started_at) / 60000000.0, 1) AS minutes_from_first
FROM top, LATERAL (SELECT unnest(sequence) AS item, generate_subscripts(sequence, 1) AS pos) p""")
def q_wave_detail(spark, sf_dir):
    return cross_region.wave_detail(waves_table(spark, sf_dir))


@register("wave_frames", _WAVES + """
, sq AS (SELECT wave_start, p.item.region AS region,
                date_diff('microsecond', wave_start, p.item.started_at) / 1000000.0 AS sec
         FROM waves, LATERAL (SELECT unnest(sequence) AS item) p),
tot AS (SELECT wave_start, max(sec) AS tot FROM sq GROUP BY 1),
f AS (SELECT sq.wave_start, sq.region, CAST(floor(sq.sec / 300) AS INTEGER) AS f0,
             greatest(CAST(floor(tot.tot / 60.0 / 5) AS INTEGER) + 2, 2) AS nf
      FROM sq JOIN tot USING (wave_start))
SELECT wave_start, CAST(unnest(generate_series(f0, nf - 1)) AS INTEGER) AS frame, region FROM f WHERE f0 <= nf - 1""")
def q_wave_frames(spark, sf_dir):
    return cross_region.wave_frames(waves_table(spark, sf_dir))


# ---- coverage -----------------------------------------------------------------

@register("unit_coverage", """
, u AS (SELECT region, unit_name, started_at AS us, finished_at AS ue FROM units
        WHERE region IS NOT NULL AND started_at IS NOT NULL),
tot AS (SELECT region, count(DISTINCT unit_name) AS tot FROM u GROUP BY 1),
ek AS (SELECT DISTINCT region, started_at, finished_at FROM af),
cnt AS (SELECT ek.region, ek.started_at, ek.finished_at, count(DISTINCT u.unit_name) AS unit_count
        FROM ek JOIN u ON u.region = ek.region AND CASE WHEN ek.finished_at IS NULL THEN u.us >= ek.started_at
             ELSE u.us < ek.finished_at AND (u.ue IS NULL OR u.ue > ek.started_at) END
        GROUP BY 1, 2, 3)
SELECT e.region, e.started_at, e.finished_at, e.duration_min, coalesce(c.unit_count, 0) AS unit_count,
       round_even(coalesce(c.unit_count, 0) / coalesce(t.tot, 1), 4) AS unit_fraction
FROM af e
LEFT JOIN cnt c ON c.region = e.region AND c.started_at = e.started_at AND c.finished_at IS NOT DISTINCT FROM e.finished_at
LEFT JOIN tot t ON t.region = e.region""")
def q_coverage(spark, sf_dir):
    eps = frame(spark, sf_dir).select("region", "started_at", "finished_at", "duration_min")
    return coverage.episode_unit_coverage(units(spark, sf_dir), eps, disjoint=True)


# ---- survival -----------------------------------------------------------------

def _km_sql(rows_cte: str) -> str:
    """KM curve per label from a CTE ``kr(label, t, ev)`` (exact ratio; no censored rows)."""
    return rows_cte + """
, kt AS (SELECT label, count(*) AS nn, sum(1 - ev) AS cens FROM kr GROUP BY 1),
kp AS (SELECT label, t, sum(m) AS m, sum(d) AS d FROM (
         SELECT label, t, count(*) AS m, sum(ev) AS d FROM kr GROUP BY 1, 2
         UNION ALL SELECT label, 0.0, 0, 0 FROM kt) GROUP BY 1, 2),
k1 AS (SELECT kp.*, kt.nn, kt.cens,
              sum(m) OVER (PARTITION BY kp.label ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n,
              sum(d) OVER (PARTITION BY kp.label ORDER BY t ROWS UNBOUNDED PRECEDING) AS dcum
       FROM kp JOIN kt USING (label)),
k2 AS (SELECT *, (nn - dcum) / nn AS survival,
              max(CASE WHEN d = n THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY t ROWS UNBOUNDED PRECEDING) AS alld,
              sum(CASE WHEN n > d THEN d / (n * (n - d)) ELSE 0.0 END) OVER (PARTITION BY label ORDER BY t ROWS UNBOUNDED PRECEDING) AS vv
       FROM k1),
km AS (SELECT label, t AS timeline, survival,
              CASE WHEN survival > 0 AND survival < 1 AND alld = 0
                   THEN round_even(exp(-exp(ln(-ln(survival)) - 1.959963984540054 * sqrt(vv) / ln(survival))), 10)
                   ELSE 1.0 END AS ci_lower,
              CASE WHEN survival > 0 AND survival < 1 AND alld = 0
                   THEN round_even(exp(-exp(ln(-ln(survival)) + 1.959963984540054 * sqrt(vv) / ln(survival))), 10)
                   ELSE 1.0 END AS ci_upper
       FROM k2)
"""


_KM_ALL = _km_sql("""
, kr AS (SELECT 'all' AS label, CAST(duration_min AS DOUBLE) AS t,
                CASE WHEN coalesce(censored, false) THEN 0 ELSE 1 END AS ev
         FROM af WHERE duration_min IS NOT NULL AND duration_min >= 0)""")


def _km_strata_sql(col: str) -> str:
    return _km_sql(f"""
, big AS (SELECT {col} FROM af WHERE {col} IS NOT NULL GROUP BY 1 HAVING count(*) >= 10),
kr AS (SELECT CAST({col} AS VARCHAR) AS label, CAST(duration_min AS DOUBLE) AS t,
              CASE WHEN coalesce(censored, false) THEN 0 ELSE 1 END AS ev
       FROM af WHERE duration_min IS NOT NULL AND duration_min >= 0 AND {col} IN (SELECT {col} FROM big))""")


def km_all(spark, sf_dir):
    return survival.kaplan_meier(frame(spark, sf_dir))


def km_hour(spark, sf_dir):
    return survival.kaplan_meier_stratified(frame(spark, sf_dir), "hour")


def _shown_strata(col: str, cond: str = "true") -> str:
    return f"""
, sc AS (SELECT {col} AS v, count(*) AS n FROM af WHERE {col} IS NOT NULL AND {cond} GROUP BY 1),
st AS (SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS position, CAST(v AS VARCHAR) AS label, n, n >= 10 AS kept FROM sc)
"""


WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
_WEEKDAY_VALUES = "(VALUES " + ", ".join(f"({i}, '{d}', '{n.replace(chr(39), chr(39) * 2)}')" for i, (d, n) in enumerate(zip(WEEKDAYS, DOW_LONG))) + ") AS wd(position, dow_name, name)"


@register("km_strata", _shown_strata("hour") + "SELECT position, label, n, kept FROM st")
def q_km_strata(spark, sf_dir):
    return survival.strata_counts(frame(spark, sf_dir), "hour")


@register("km_by_weekday", _km_sql("""
, kr AS (SELECT dow_name AS label, CAST(duration_min AS DOUBLE) AS t, CASE WHEN coalesce(censored, false) THEN 0 ELSE 1 END AS ev
         FROM af WHERE duration_min IS NOT NULL AND duration_min >= 0)""") + f"""
SELECT wd.name AS label, timeline, survival, ci_lower, ci_upper, CAST(wd.position AS INTEGER) AS position
FROM km JOIN {_WEEKDAY_VALUES} ON wd.dow_name = km.label""")
def q_km_weekday(spark, sf_dir):
    return survival.kaplan_meier_stratified(frame(spark, sf_dir), "dow_name", WEEKDAYS, labels=dict(zip(WEEKDAYS, DOW_LONG)))


@register("weekday_counts", "SELECT dow, ['Пн', 'Вт', 'Ср', 'Чт', 'Пт', 'Сб', 'Нд'][dow + 1] AS dow_short, "
          f"(SELECT name FROM {_WEEKDAY_VALUES} WHERE wd.position = dow) AS dow_long, count(*) AS n FROM af GROUP BY 1, 2, 3")
def q_weekday_counts(spark, sf_dir):
    counts = frame(spark, sf_dir).groupBy("dow").agg(F.count(F.lit(1)).alias("n"))
    return shape.weekday_labels(counts)


TIMES = [0, 7.5, 30, 60, 95, 240, 1000]


@register("km_timeline", _KM_ALL + f"""
, tm AS (SELECT CAST(unnest({TIMES}) AS DOUBLE) AS timeline)
SELECT 'all' AS label, tm.timeline, k.survival, k.ci_lower, k.ci_upper
FROM tm JOIN km k ON k.timeline = (SELECT max(x.timeline) FROM km x WHERE x.timeline <= tm.timeline)""")
def q_km_timeline(spark, sf_dir):
    return survival.kaplan_meier(frame(spark, sf_dir), timeline=TIMES)


@register("km_median_remaining_at", _km_strata_sql("hour") + """
, past AS (SELECT label, timeline, survival, first_value(survival) OVER (PARTITION BY label ORDER BY timeline) AS s0 FROM km WHERE timeline >= 47.25)
SELECT l.label, CAST(47.25 AS DOUBLE) AS elapsed, min(past.timeline) FILTER (WHERE past.survival <= past.s0 * 0.5) - 47.25 AS median_remaining
FROM (SELECT DISTINCT label FROM km) l LEFT JOIN past ON past.label = l.label GROUP BY l.label""")
def q_km_remaining_at(spark, sf_dir):
    return survival.median_remaining_at(km_hour(spark, sf_dir), 47.25)


@register("km_curve", _KM_ALL + "SELECT * FROM km")
def q_km(spark, sf_dir):
    return km_all(spark, sf_dir)


@register("km_by_hour", _km_strata_sql("hour") + _shown_strata("hour") + "SELECT km.*, st.position FROM km JOIN st ON st.label = km.label")
def q_km_hour(spark, sf_dir):
    return km_hour(spark, sf_dir)


@register("km_by_dow", _km_strata_sql("dow") + _shown_strata("dow") + "SELECT km.*, st.position FROM km JOIN st ON st.label = km.label")
def q_km_dow(spark, sf_dir):
    return survival.kaplan_meier_stratified(frame(spark, sf_dir), "dow")


@register("km_hazard", _km_strata_sql("hour") + """
, hz AS (SELECT label, timeline, survival,
                lead(survival) OVER (PARTITION BY label ORDER BY timeline) AS sn,
                lead(timeline) OVER (PARTITION BY label ORDER BY timeline) AS tn FROM km)
SELECT label, timeline,
       CASE WHEN sn IS NOT NULL AND tn - timeline > 0 AND survival > 0 AND sn <= survival
            THEN -(sn - survival) / ((tn - timeline) * survival) END AS hazard
FROM hz""")
def q_km_hazard(spark, sf_dir):
    return survival.hazard(km_hour(spark, sf_dir))


@register("km_median_remaining", _KM_ALL + """
SELECT a.label, a.timeline AS elapsed,
       (SELECT min(b.timeline) FROM km b WHERE b.label = a.label AND b.survival <= a.survival / 2.0) - a.timeline
         AS median_remaining
FROM km a""")
def q_km_remaining(spark, sf_dir):
    return survival.median_remaining(km_all(spark, sf_dir))


@register("km_median", _km_strata_sql("hour") + """
SELECT label, coalesce(min(timeline) FILTER (WHERE survival <= 0.5), 600.0) AS median_min,
       min(timeline) FILTER (WHERE survival <= 0.5) IS NULL AS capped
FROM km GROUP BY label""")
def q_km_median(spark, sf_dir):
    return survival.km_median(km_hour(spark, sf_dir))


@register("km_truncated", _km_strata_sql("hour") + _shown_strata("hour") + """
, fb AS (SELECT label, min(timeline) FILTER (WHERE survival < 0.05) AS fb FROM km GROUP BY label),
xm AS (SELECT least(600.0, max(timeline)) AS x_max FROM km)
SELECT km.label, km.timeline, km.survival, km.ci_lower, km.ci_upper, st.position,
       fb.fb IS NULL OR km.timeline <= fb.fb AS shown, xm.x_max
FROM km JOIN fb USING (label) JOIN xm ON true JOIN st ON st.label = km.label""")
def q_km_truncated(spark, sf_dir):
    return survival.km_truncated(km_hour(spark, sf_dir))


# ---- quality ------------------------------------------------------------------

_DIM_SQL = "(VALUES " + ", ".join(f"('{r}')" for r in PROFILE.region_names) + ") AS dim(region)"
_EXCL_SQL = "(VALUES " + ", ".join(f"('{r}')" for r in PROFILE.excluded) + ") AS ex(region)"

_GAPS = f"""
, found AS (SELECT DISTINCT region FROM episodes_d WHERE region IS NOT NULL),
gaps AS (
  SELECT 'unknown' AS kind, region FROM found
  WHERE region NOT IN (SELECT region FROM {_DIM_SQL}) AND region NOT IN (SELECT region FROM {_EXCL_SQL})
  UNION ALL
  SELECT 'missing' AS kind, region FROM {_DIM_SQL}
  WHERE region NOT IN (SELECT region FROM {_EXCL_SQL}) AND region NOT IN (SELECT region FROM found))
"""


# a region dimension with one region that never occurs and without one that does
GAP_PROFILE = dataclasses.replace(PROFILE, regions=(*(r for r in PROFILE.regions if r[0] != "R05"), ("R99", "Region 99", 50.0, 30.0)))


@register("region_gaps", """
, found AS (SELECT DISTINCT region FROM episodes_d WHERE region IS NOT NULL),
dim AS (SELECT 'R' || lpad(CAST(i AS VARCHAR), 2, '0') AS region FROM range(25) t(i) WHERE i <> 5 UNION ALL SELECT 'R99')
SELECT 'unknown' AS kind, region FROM found WHERE region <> 'R24' AND region NOT IN (SELECT region FROM dim)
UNION ALL
SELECT 'missing' AS kind, region FROM dim WHERE region <> 'R24' AND region NOT IN (SELECT region FROM found)""")
def q_gaps(spark, sf_dir):
    return quality.region_gaps(episodes(spark, sf_dir), GAP_PROFILE)


@register("quality_report", _GAPS + f"""
, one AS (SELECT count(*) AS n_rows,
                 count(*) FILTER (WHERE finished_at < started_at) AS n_order,
                 count(*) FILTER (WHERE duration_min < 0) AS n_neg,
                 count(*) FILTER (WHERE duration_min = 0) AS n_zero,
                 count(*) FILTER (WHERE started_at < TIMESTAMP '{PROFILE.official_start} 00:00:00') AS n_early,
                 count(*) FILTER (WHERE finished_at IS NULL) AS n_open
          FROM episodes_d),
dup AS (SELECT coalesce(sum(c - 1), 0) AS n_dup FROM (
          SELECT count(*) AS c FROM episodes_d GROUP BY region, started_at, finished_at)),
g AS (SELECT count(*) FILTER (WHERE kind = 'unknown') AS n_unknown, count(*) FILTER (WHERE kind = 'missing') AS n_missing FROM gaps),
r AS (
  SELECT 0 AS position, 'schema' AS "check", 'raise' AS severity, 0 AS n_bad
  UNION ALL SELECT 1, 'row_count', 'raise', CASE WHEN n_rows < {PROFILE.min_rows} THEN n_rows ELSE 0 END FROM one
  UNION ALL SELECT 2, 'date_order', 'raise', n_order FROM one
  UNION ALL SELECT 3, 'negative_duration', 'raise', n_neg FROM one
  UNION ALL SELECT 4, 'zero_duration', 'warn', n_zero FROM one
  UNION ALL SELECT 5, 'duplicates', 'raise', n_dup FROM dup
  UNION ALL SELECT 6, 'unknown_regions', 'warn', n_unknown FROM g
  UNION ALL SELECT 7, 'missing_regions', 'warn', n_missing FROM g
  UNION ALL SELECT 8, 'coverage_start', 'warn', n_early FROM one
  UNION ALL SELECT 9, 'open_intervals', 'warn', n_open FROM one)
SELECT CAST(position AS INTEGER) AS position, "check", severity, CAST(n_bad AS BIGINT) AS n_bad, n_bad = 0 AS passed FROM r""")
def q_quality(spark, sf_dir):
    return quality.quality_report(episodes(spark, sf_dir), PROFILE)


@register("quality_report_schema", None)
def q_quality_schema(spark, sf_dir):
    """The report on a table without one of the required columns: V1 fails, the checks on it have nothing to count."""
    return quality.quality_report(episodes(spark, sf_dir).drop("duration_min"), PROFILE)


REGISTRY["quality_report_schema"] = (q_quality_schema, f"""
SELECT position, "check", severity, CASE "check" WHEN 'schema' THEN 1 WHEN 'negative_duration' THEN 0 WHEN 'zero_duration' THEN 0 ELSE n_bad END AS n_bad,
       CASE "check" WHEN 'schema' THEN false WHEN 'negative_duration' THEN true WHEN 'zero_duration' THEN true ELSE passed END AS passed
FROM ({REGISTRY["quality_report"][1]})""")


# ---- reconciliation -----------------------------------------------------------

def second(spark, sf_dir):
    return reconcile.second_source(second_source_from_events(pipeline.read_table(spark, sf_dir, "events")), PROFILE)


_SECOND = """
, sd AS (SELECT DISTINCT region, started_at, kind FROM second_raw),
sc AS (SELECT coalesce(a.canonical, sd.region) AS region,
              TRY_CAST(sd.started_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS started_at, sd.kind
       FROM sd LEFT JOIN alias_map a ON a.variant = sd.region),
vol AS (SELECT * FROM sc WHERE started_at >= TIMESTAMP '2022-03-15 00:00:00'),
cmp AS (
  SELECT coalesce(o.region, v.region) AS region, coalesce(o.official, 0) AS official, coalesce(v.volunteer, 0) AS volunteer
  FROM (SELECT region, count(*) AS official FROM episodes_d WHERE region IS NOT NULL GROUP BY 1) o
  FULL OUTER JOIN (SELECT region, count(*) AS volunteer FROM vol WHERE region IS NOT NULL GROUP BY 1) v
  ON o.region = v.region),
cmp2 AS (SELECT region, official, volunteer,
                round_even(official / CASE WHEN volunteer = 0 THEN 1 ELSE volunteer END, 2) AS ratio_off_vol
         FROM cmp WHERE region IS NOT NULL AND region NOT IN ('""" + "', '".join(PROFILE.excluded) + """'))
"""


@register("scan_second_source", _SECOND + "SELECT region, started_at, kind FROM vol")
def q_second(spark, sf_dir):
    return second(spark, sf_dir)


@register("source_compare", _SECOND + "SELECT region, official, volunteer, ratio_off_vol FROM cmp2")
def q_source_compare(spark, sf_dir):
    return reconcile.compare_sources(episodes(spark, sf_dir), second(spark, sf_dir), PROFILE)


@register("source_spearman", _SECOND + """
, rk AS (SELECT rank() OVER (ORDER BY official) + (count(*) OVER (PARTITION BY official) - 1) / 2.0 AS x,
                rank() OVER (ORDER BY volunteer) + (count(*) OVER (PARTITION BY volunteer) - 1) / 2.0 AS y FROM cmp2),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM rk),
r AS (SELECT CASE WHEN sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) > 0
                  THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END AS rho FROM s)
SELECT round_even(rho, 6) + 0.0 AS rho, coalesce(rho >= 0.8, false) AS agree FROM r""")
def q_source_spearman(spark, sf_dir):
    return reconcile.source_spearman(reconcile.compare_sources(episodes(spark, sf_dir), second(spark, sf_dir), PROFILE))


# ---- presentation shaping -----------------------------------------------------

@register("timeline_sample", """
, st AS (SELECT max(greatest(started_at, finished_at)) AS latest FROM af)
SELECT region, started_at, finished_at, duration_min,
       row_number() OVER (PARTITION BY region ORDER BY duration_min DESC NULLS LAST, started_at) AS rank_in_region,
       coalesce(finished_at, st.latest) AS plot_end
FROM af JOIN st ON true""")
def q_timeline(spark, sf_dir):
    return shape.timeline_sample(frame(spark, sf_dir))


_DIM_FULL = "(VALUES " + ", ".join(f"('{r[0]}', '{r[1]}', {r[2]}, {r[3]})" for r in PROFILE.regions) + \
    ") AS dim(region, name_en, lat, lon)"


@register("region_metric_map", f"""
, m AS (SELECT region, count(started_at) AS alert_count FROM af WHERE region IS NOT NULL GROUP BY region)
SELECT dim.region, dim.name_en, CAST(dim.lat AS DOUBLE) AS lat, CAST(dim.lon AS DOUBLE) AS lon, m.alert_count,
       m.alert_count IS NOT NULL AS has_data
FROM {_DIM_FULL} LEFT JOIN m ON m.region = dim.region""")
def q_region_map(spark, sf_dir):
    return shape.region_metric_map(describe.regional_breakdown(frame(spark, sf_dir)), PROFILE)


# ---- the second binding: orders over seven years -------------------------------

def orders_frame(spark, sf_dir) -> DataFrame:
    return temporal.prepare(intervals_from_orders(pipeline.read_table(spark, sf_dir, "orders")), PROFILE, exclude_permanent=False)


def register_orders(name: str, sql: str):
    """Register a query on the orders binding; ``sql`` reads ``af`` as the other queries do."""
    def deco(fn):
        REGISTRY[name] = (fn, "WITH " + ORDERS_SQL.strip() + "\n" + sql)
        return fn
    return deco


@register_orders("orders_freq_daily", _freq_sql("date", "INTERVAL 1 DAY", "CAST(lo AS TIMESTAMP)", "CAST(hi AS TIMESTAMP)"))
def q_orders_daily(spark, sf_dir):
    return describe.frequency_over_time(orders_frame(spark, sf_dir), "D")


@register_orders("orders_freq_weekly", _freq_sql("CAST(date + CAST(7 - isodow(date) AS INTEGER) AS DATE)", "INTERVAL 7 DAY",
                                                 "CAST(lo AS TIMESTAMP)", "CAST(hi AS TIMESTAMP)"))
def q_orders_weekly(spark, sf_dir):
    return describe.frequency_over_time(orders_frame(spark, sf_dir), "W")


@register_orders("orders_freq_monthly", _freq_sql("last_day(date)", "INTERVAL 1 MONTH", "CAST(date_trunc('month', lo) AS TIMESTAMP)",
                                                  "CAST(date_trunc('month', hi) AS TIMESTAMP)", label="last_day(p)"))
def q_orders_monthly(spark, sf_dir):
    return describe.frequency_over_time(orders_frame(spark, sf_dir), "ME")


@register_orders("orders_cumulative", """
, d AS (SELECT s.date, count(af.date) AS daily_count FROM (
          SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM af) s
        LEFT JOIN af ON af.date = s.date GROUP BY 1)
SELECT date, daily_count, sum(daily_count) OVER (ORDER BY date) AS cumulative FROM d""")
def q_orders_cumulative(spark, sf_dir):
    return describe.cumulative_daily(orders_frame(spark, sf_dir))


@register_orders("orders_year_month", """
, y AS (SELECT DISTINCT CAST(year(local_start) AS INTEGER) AS year FROM af)
SELECT y.year, CAST(m.month AS INTEGER) AS month, count(af.local_start) AS n
FROM y JOIN range(1, 13) m(month) ON true LEFT JOIN af ON year(af.local_start) = y.year AND month(af.local_start) = m.month GROUP BY 1, 2""")
def q_orders_year_month(spark, sf_dir):
    return seasonal.year_month_counts(orders_frame(spark, sf_dir))


@register_orders("orders_rolling_7d", """
, d AS (SELECT s.date, count(af.date) AS count FROM (
          SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM af) s
        LEFT JOIN af ON af.date = s.date GROUP BY 1)
SELECT x.date, x.count, CASE WHEN x.date >= (SELECT min(date) FROM d) + 6
       THEN round_even((SELECT avg(y.count) FROM d y WHERE y.date BETWEEN x.date - 6 AND x.date), 1) END AS rolling_7d
FROM d x""")
def q_orders_rolling(spark, sf_dir):
    return seasonal.rolling_7d(orders_frame(spark, sf_dir))


@register("co_occurrence_triangle", _STARTS + """
, n AS (SELECT region, count(*) AS n FROM s GROUP BY 1),
h AS (SELECT x.region AS a, y.region AS b, count(DISTINCT x.id) AS h FROM s x JOIN s y
      ON y.region <> x.region AND y.us BETWEEN x.us - 7200000000 AND x.us + 7200000000 GROUP BY 1, 2)
SELECT p.region AS region_a, q.region AS region_b,
       (coalesce((SELECT h FROM h WHERE a = p.region AND b = q.region), 0) / p.n
        + coalesce((SELECT h FROM h WHERE a = q.region AND b = p.region), 0) / q.n) / 2.0 AS value
FROM n p JOIN n q ON p.region > q.region""")
def q_cooc_triangle(spark, sf_dir):
    return cross_region.co_occurrence(frame(spark, sf_dir), 2.0, lower_triangle=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
