"""Descriptive aggregates on the analysis frame.

Inputs are the output of ``temporal.prepare`` (episodes + local calendar
columns).  Every aggregate is a hash aggregate with map-side partial combine;
zero-filled calendars join the counts to a spine generated from the observed
bounds, so the spine grows with the time span, never with the row count.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.scans import running
from spanwise.operators.temporal import with_scalars

FREQ_DAY, FREQ_WEEK, FREQ_MONTH = "D", "W", "ME"


def _period(freq: str) -> F.Column:
    d = F.col("date")
    if freq == FREQ_DAY:
        return d
    if freq == FREQ_WEEK:  # Monday..Sunday weeks, labelled with their Sunday
        return F.next_day(F.date_sub(d, 1), "Sun")
    if freq == FREQ_MONTH:  # labelled with the month's last day
        return F.last_day(d)
    raise ValueError(f"unsupported frequency {freq!r} (use D, W or ME)")


def zero_filled_counts(df: DataFrame, freq: str, out: str = "alert_count") -> DataFrame:
    """Counts per calendar period with every period between the first and last filled."""
    counts = df.select(_period(freq).alias("period")).groupBy("period").agg(F.count(F.lit(1)).alias(out))
    bounds = counts.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    if freq == FREQ_DAY:
        seq = F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))
    elif freq == FREQ_WEEK:
        seq = F.sequence("lo", "hi", F.expr("INTERVAL 7 DAY"))
    else:
        seq = F.transform(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("INTERVAL 1 MONTH")),
                          lambda x: F.last_day(x))
    spine = bounds.filter(F.col("lo").isNotNull()).select(F.explode(seq).alias("period"))
    return spine.join(counts, "period", "left").select(
        "period", F.coalesce(F.col(out), F.lit(0)).cast("long").alias(out)
    )


def frequency_over_time(df: DataFrame, freq: str = FREQ_WEEK, regions=None) -> DataFrame:
    """(period, alert_count), zero-filled between first and last period."""
    data = df.filter(F.col("region").isin(list(regions))) if regions else df
    return zero_filled_counts(data, freq)


def _closed_durations(df: DataFrame) -> DataFrame:
    if "censored" not in df.columns:
        raise ValueError("duration statistics need a 'censored' column; run temporal.prepare first")
    return df.filter(~F.coalesce(F.col("censored"), F.lit(False)) & F.col("duration_min").isNotNull())


def exact_quantiles(values: DataFrame, col: str, probs: list[float]) -> DataFrame:
    """One row ``q`` (array): exact quantiles with linear interpolation, NULLs ignored.

    Values are counted first (map-side combine); a two-level running count over the distinct
    values gives ranks, and each rank picks its value in one aggregate.  No task holds all
    distinct values.  The number of values is one aggregate row, read when the plan is built.
    """
    counts = values.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_b", F.floor("_v").cast("long"))
    n = counts.agg(F.sum("_n")).first()[0] or 0
    if not n:
        return values.sparkSession.range(1).select(F.array(*[F.lit(None).cast("double") for _ in probs]).alias("q"))
    ranked = running(counts, [], "_b", [F.asc("_v")], [("_cum", "_n", "sum")])
    picks = []
    for k, p in enumerate(probs):
        rank = (n - 1) * p
        for side, r in (("lo", math.floor(rank)), ("hi", math.ceil(rank))):
            picks.append(F.min(F.when(F.col("_cum") > r, F.col("_v"))).alias(f"{side}{k}"))
    ends = ranked.agg(*picks)
    return ends.select(F.array(*[
        F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * ((n - 1) * p - math.floor((n - 1) * p))
        for k, p in enumerate(probs)
    ]).alias("q"))


def duration_stats(df: DataFrame) -> DataFrame:
    """One row of duration statistics over closed episodes; no row when there are none.

    Quantiles are exact with linear interpolation (``exact_quantiles``).
    """
    d = _closed_durations(df)
    v = F.col("duration_min")
    out = d.agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean_min"),
        F.max(v).alias("max_min"),
        F.stddev_samp(v).alias("std_min"),
        (F.sum(v) / 60.0).alias("total_hours"),
    )
    out = with_scalars(out, exact_quantiles(d, "duration_min", [0.25, 0.5, 0.75, 0.95]))
    return out.filter(F.col("count") > 0).select(
        "count",
        F.bround("mean_min", 6).alias("mean_min"),
        F.bround(F.col("q")[1], 6).alias("median_min"),
        F.bround(F.col("q")[0], 6).alias("p25_min"),
        F.bround(F.col("q")[2], 6).alias("p75_min"),
        F.bround(F.col("q")[3], 6).alias("p95_min"),
        F.bround("max_min", 6).alias("max_min"),
        F.bround("std_min", 6).alias("std_min"),
        F.bround("total_hours", 6).alias("total_hours"),
    )


def duration_histogram(df: DataFrame, max_minutes: float = 300.0, n_bins: int = 60) -> DataFrame:
    """D3 + H6: fixed bins over [0, max]; values above max are excluded (not clipped).

    Bin assignment follows uniform-edge histogram rules: index = floor(v * n / max),
    corrected against the edges ``i * max / n``; the last bin is closed on the right.
    Columns: bin, bin_left, bin_right, bin_mid, bin_width, count, n_total,
    n_excluded, excluded_share.
    """
    d = _closed_durations(df).select(F.col("duration_min").alias("v"))
    width = float(max_minutes) / n_bins

    def edge(i):
        return F.when(i >= n_bins, F.lit(float(max_minutes))).otherwise(i.cast("double") * F.lit(width))

    raw_idx = F.least(F.floor(F.col("v") * F.lit(n_bins / float(max_minutes))), F.lit(n_bins - 1)).cast("int")
    inside = (F.col("v") >= 0) & (F.col("v") <= F.lit(float(max_minutes)))
    binned = d.withColumn("_i", raw_idx)
    binned = binned.withColumn("_i", F.when(F.col("v") < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    binned = binned.withColumn(
        "_i",
        F.when((F.col("v") >= edge(F.col("_i") + 1)) & (F.col("_i") != n_bins - 1), F.col("_i") + 1).otherwise(F.col("_i")),
    )
    totals = d.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("v") > F.lit(float(max_minutes))).alias("n_excluded"),
    )
    counts = binned.filter(inside).groupBy(F.col("_i").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = totals.select(F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    i = F.col("bin")
    out = spine.join(counts, "bin", "left")
    out = with_scalars(out, totals).select(
        "bin",
        edge(i).alias("bin_left"),
        edge(i + 1).alias("bin_right"),
        ((edge(i) + edge(i + 1)) / 2).alias("bin_mid"),
        (edge(i + 1) - edge(i)).alias("bin_width"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
        F.col("n_total").cast("long").alias("n_total"),
        F.col("n_excluded").cast("long").alias("n_excluded"),
        F.try_divide(F.col("n_excluded").cast("double"), F.col("n_total").cast("double")).alias("excluded_share"),
    )
    return out


def regional_breakdown(df: DataFrame) -> DataFrame:
    """Per region — starts, mean duration (1 dp, open rows skipped), total hours (1 dp)."""
    return (
        df.filter(F.col("region").isNotNull())
        .groupBy("region")
        .agg(
            F.count("started_at").alias("alert_count"),
            F.bround(F.avg("duration_min"), 1).alias("mean_duration_min"),
            F.bround(F.sum("duration_min") / 60.0, 1).alias("total_duration_h"),
        )
        .orderBy(F.desc("alert_count"), "region")
    )


def top_days(df: DataFrame, n: int | None = None) -> DataFrame:
    """Local dates by number of starts (ties by date) with their rank; ``n`` keeps the first n.

    The rank is a window over the day table (one row per day of the span), never over raw rows.
    """
    days = df.groupBy("date").agg(F.count(F.lit(1)).alias("alert_count"))
    days = days.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("alert_count"), "date")))
    return days if n is None else days.filter(F.col("rank") <= n)


def cumulative_daily(df: DataFrame) -> DataFrame:
    """Zero-filled daily counts and their running total.

    The running sum is a window over the day table (one row per day of the span),
    which is tiny next to the data; it never sees raw rows.
    """
    daily = zero_filled_counts(df, FREQ_DAY, out="daily_count").withColumnRenamed("period", "date")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cumulative", F.sum("daily_count").over(w))


def header_metrics(df: DataFrame) -> DataFrame:
    """One row — episodes, distinct regions, median duration, total hours, first/last start."""
    closed = ~F.coalesce(F.col("censored"), F.lit(False))
    out = df.agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.countDistinct("region").alias("n_regions"),
        F.bround(F.sum(F.when(closed, F.col("duration_min"))) / 60.0, 6).alias("total_hours"),
        F.min("started_at").alias("first_start"),
        F.max("started_at").alias("last_start"),
    )
    out = with_scalars(out, exact_quantiles(df.filter(closed), "duration_min", [0.5]))
    return out.select("n_episodes", "n_regions", F.bround(F.col("q")[0], 6).alias("median_duration_min"),
                      "total_hours", "first_start", "last_start")
