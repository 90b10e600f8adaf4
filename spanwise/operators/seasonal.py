"""Seasonality (E1-E6).  Long-form outputs; pivot only at the presentation edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.config import DOW_SHORT, NIGHT_END_HOUR, NIGHT_START_HOUR
from spanwise.functions import timecols as tc
from spanwise.operators.describe import FREQ_DAY, zero_filled_counts
from spanwise.operators.temporal import with_scalars


def _short_dow(dow: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in DOW_SHORT]), dow + 1)


def hour_dow_rate(df: DataFrame) -> DataFrame:
    """Starts per (hour, weekday) divided by the number of weeks, full 24 x 7 grid, 2 dp.

    weeks = max(1, whole days between first and last start / 7).
    """
    counts = df.groupBy("hour", "dow").agg(F.count(F.lit(1)).alias("n"))
    span = df.agg(
        F.greatest(
            F.lit(1.0),
            F.floor(tc.micros_between(F.min("started_at"), F.max("started_at")) / F.lit(86_400_000_000)) / F.lit(7.0),
        ).alias("n_weeks"),
        F.count(F.lit(1)).alias("_rows"),
    ).filter(F.col("_rows") > 0)
    grid = span.select(
        "n_weeks",
        F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"),
    ).select("n_weeks", "hour", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dow"))
    return grid.join(counts, ["hour", "dow"], "left").select(
        "hour",
        "dow",
        _short_dow(F.col("dow")).alias("dow_short"),
        F.bround(F.coalesce(F.col("n"), F.lit(0)) / F.col("n_weeks"), 2).alias("rate"),
    )


def year_month_counts(df: DataFrame) -> DataFrame:
    """Starts per (year, month) for every year present, months 1-12 zero-filled."""
    counts = df.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))
    grid = df.select("year").distinct().select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return grid.join(counts, ["year", "month"], "left").select(
        "year", "month", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")
    )


def hour_region(df: DataFrame, regions=None, normalize: bool = False) -> DataFrame:
    """Starts per (hour, region); ``normalize`` divides by the region's total (0 -> 1).

    Grid: hours present x regions present (or the requested region list, zero-filled);
    hours are not zero-filled.
    """
    data = df.filter(F.col("region").isin(list(regions))) if regions else df.filter(F.col("region").isNotNull())
    counts = data.groupBy("hour", "region").agg(F.count(F.lit(1)).alias("n"))
    hours = data.agg(F.collect_set("hour").alias("_hours"))  # at most 24 values
    if regions:
        reg = df.sparkSession.createDataFrame([(r,) for r in regions], "region string")
    else:
        reg = data.select("region").distinct()
    grid = with_scalars(reg, hours).select("region", F.explode("_hours").alias("hour"))
    out = grid.join(counts, ["hour", "region"], "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("long"))
    if not normalize:
        return out.select("hour", "region", "n")
    tot = out.groupBy("region").agg(F.sum("n").alias("_tot"))
    return out.join(tot, "region").select(
        "hour", "region",
        (F.col("n") / F.when(F.col("_tot") == 0, F.lit(1)).otherwise(F.col("_tot"))).alias("share"),
    )


def duration_by_hour(df: DataFrame) -> DataFrame:
    """Mean closed-episode duration per start hour (1 dp), hours present only."""
    closed = df.filter(~F.coalesce(F.col("censored"), F.lit(False)))
    return closed.groupBy("hour").agg(F.bround(F.avg("duration_min"), 1).alias("mean_duration_min"))


def night_ratio(df: DataFrame) -> DataFrame:
    """E5: night = hour >= 20 or < 6 (local); fraction over max(n, 1)."""
    night = (F.col("hour") >= NIGHT_START_HOUR) | (F.col("hour") < NIGHT_END_HOUR)
    agg = df.agg(F.count_if(night).alias("night_count"), F.count(F.lit(1)).alias("_n"))
    return agg.select(
        F.col("night_count").cast("long").alias("night_count"),
        (F.col("_n") - F.col("night_count")).cast("long").alias("day_count"),
        (F.col("night_count") / F.greatest(F.col("_n"), F.lit(1))).alias("night_fraction"),
    )


def rolling_7d(df: DataFrame) -> DataFrame:
    """Zero-filled daily counts + 7-day trailing mean (NULL until 7 days exist), 1 dp.

    The window runs over the day table (one row per day of the span).
    """
    daily = zero_filled_counts(df, FREQ_DAY, out="count").withColumnRenamed("period", "date")
    w = Window.orderBy("date").rowsBetween(-6, 0)
    return daily.select(
        "date", "count",
        F.when(F.count(F.lit(1)).over(w) == 7, F.bround(F.avg("count").over(w), 1)).alias("rolling_7d"),
    )
