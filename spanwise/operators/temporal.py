"""Time features on episodes (T1-T7) and the binary activity series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.config import Profile
from spanwise.functions import timecols as tc
from spanwise.operators import clean

FEATURE_COLUMNS = ["censored", "local_start", "hour", "dow", "dow_name", "month", "month_name", "year", "date", "week"]


def to_local_col(col: str, tz: str) -> F.Column:
    return tc.to_local(col, tz)


def local_time(df: DataFrame, tz: str, col: str = "started_at", out: str = "local_start") -> DataFrame:
    """UTC instant -> local wall-clock time (DST-aware)."""
    return df.withColumn(out, tc.to_local(col, tz))


def mark_censored(df: DataFrame) -> DataFrame:
    """Open interval = right-censored."""
    return df.withColumn("censored", F.col("finished_at").isNull())


def recompute_duration(df: DataFrame) -> DataFrame:
    """Minutes between the instants where both exist, else the existing value."""
    exact = tc.minutes_between("started_at", "finished_at")
    if "duration_min" in df.columns:
        return df.withColumn("duration_min", F.coalesce(exact, F.col("duration_min")))
    return df.withColumn("duration_min", exact)


def calendar_features(df: DataFrame, tz: str) -> DataFrame:
    """T4: hour, dow (0 = Monday), names, month, year, local date, ISO week — from local time."""
    local = tc.to_local("started_at", tz)
    return df.select(
        "*",
        local.alias("local_start"),
        F.hour(local).alias("hour"),
        F.weekday(local).alias("dow"),
        F.date_format(local, "EEEE").alias("dow_name"),
        F.month(local).alias("month"),
        F.date_format(local, "MMMM").alias("month_name"),
        F.year(local).alias("year"),
        F.to_date(local).alias("date"),
        F.weekofyear(local).alias("week"),
    )


def prepare(eps: DataFrame, profile: Profile, exclude_permanent: bool = True) -> DataFrame:
    """T5: normalise -> censor -> duration -> exclude (optional) -> features."""
    df = clean.canonical_region(eps, profile.aliases, src="region", dst="region")
    df = mark_censored(df)
    df = recompute_duration(df)
    if exclude_permanent:
        df = clean.exclude_regions(df, profile.excluded)
    return calendar_features(df, profile.tz)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the values of a one-row aggregate (bounds, totals) to every row as typed literals.

    The aggregate is evaluated once when the plan is built: a single bounded row, not data.
    (As a scalar subquery Catalyst copies it into every expression that reads a field, and
    the copies are not reused, so the aggregate would run many times per query.)
    """
    rows = one_row.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("with_scalars expects a one-row aggregate")
    values = rows[0].asDict() if rows else {f.name: None for f in one_row.schema.fields}
    return df.select(
        *[F.col(c) for c in df.columns],
        *[F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in one_row.schema.fields],
    )


def days_since_start(df: DataFrame, profile: Profile) -> DataFrame:
    """Floor of elapsed days since local midnight of the origin date (elapsed, not calendar)."""
    origin = tc.from_local(F.lit(profile.cover_start + " 00:00:00").cast("timestamp_ntz"), profile.tz)
    micros = tc.micros_between(origin, "started_at")
    return df.withColumn("ndays", F.floor(micros / F.lit(86_400_000_000)).cast("long"))


def series_bounds(df: DataFrame, freq_seconds: int) -> tuple[int, int] | None:
    """First and last bucket index of the activity series (one aggregate row, read when the plan
    is built); None without any start."""
    us = int(freq_seconds) * 1_000_000
    up = lambda c: -F.floor(-tc.epoch_micros(c) / F.lit(us))
    row = df.filter(F.col("started_at").isNotNull()).agg(
        F.min(F.floor(tc.epoch_micros("started_at") / F.lit(us))).alias("lo"),
        # ceil(max(last closed end, last open start + freq))
        F.greatest(F.max(up("finished_at")), F.max(F.when(F.col("finished_at").isNull(), up("started_at") + 1))).alias("hi"),
    ).first()
    return None if row["lo"] is None else (int(row["lo"]), int(row["hi"]))


def active_cells(df: DataFrame, freq_seconds: int, hi: int) -> DataFrame:
    """Distinct active (region, b).  Rows are reduced before they are spread over buckets: closed
    ones to the last bucket per (region, first bucket), open ones to the first bucket per region."""
    us = int(freq_seconds) * 1_000_000
    first = F.floor(tc.epoch_micros("started_at") / F.lit(us)).cast("long")
    end = (-F.floor(-tc.epoch_micros("finished_at") / F.lit(us))).cast("long")
    d = df.filter(F.col("region").isNotNull() & F.col("started_at").isNotNull())
    closed = d.filter(F.col("finished_at").isNotNull()).groupBy("region", first.alias("b0")).agg(F.max(end).alias("b1"))
    still = d.filter(F.col("finished_at").isNull()).groupBy("region").agg(F.min(first).alias("b0"))
    spans = closed.unionByName(still.withColumn("b1", F.lit(hi).cast("long"))).filter(F.col("b1") > F.col("b0"))
    return spans.select("region", F.explode(F.sequence(F.col("b0"), F.col("b1") - 1)).alias("b")).distinct()


def binary_series(df: DataFrame, freq_seconds: int = 3600, regions: list[str] | None = None,
                  dense: bool = True, tz: str | None = None) -> DataFrame:
    """Long-form activity series ``(bucket, region, active)``.

    A bucket is active iff ``bucket >= floor(start)`` and ``bucket < ceil(end)``.
    The index runs from ``floor(min start)`` to ``t_max`` inclusive, where
    ``t_max = ceil(max(last closed end, last open start + freq))``; open rows run
    to ``t_max``.  Buckets are aligned in UTC (the zone offset is whole hours, so
    hourly buckets coincide with local ones and no fold hour is ambiguous).

    With ``tz`` the instants are first converted to local wall-clock time, so buckets
    of a day or longer start at local midnight (labels are local times).

    Sparse output (``dense=False``) lists only active cells; the dense form
    joins the active cells to the bucket spine x region list and fills 0.  The
    spine has ``span / freq`` rows — bounded by the time span, not the data.
    """
    if tz is not None:
        # buckets aligned to local wall-clock time (daily buckets start at local midnight);
        # bucket labels are then local times
        df = df.withColumn("started_at", to_local_col("started_at", tz)).withColumn(
            "finished_at", to_local_col("finished_at", tz))
    bounds = series_bounds(df, freq_seconds)
    lo, hi = bounds or (0, -1)
    d = df.filter(F.col("region").isNotNull() & F.col("started_at").isNotNull())
    if regions:
        d = d.filter(F.col("region").isin(list(regions)))
    active = active_cells(d, freq_seconds, hi).withColumn("active", F.lit(1))
    if not dense:
        return active.select(tc.bucket_start(F.col("b"), freq_seconds).alias("bucket"), "region", "active")
    spark = df.sparkSession
    if regions:
        reg = spark.createDataFrame([(r,) for r in regions], "region string")
    else:
        reg = d.select("region").distinct()
    if bounds is None:
        reg = reg.limit(0)
    # each region row expands its own bucket range (span / freq entries)
    grid = reg.select("region", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))).alias("b"))
    return grid.join(active, ["b", "region"], "left").select(
        tc.bucket_start(F.col("b"), freq_seconds).alias("bucket"),
        "region",
        F.coalesce(F.col("active"), F.lit(0)).alias("active"),
    )
