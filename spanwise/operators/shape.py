"""Data shaping done for presentation (H1-H6), kept as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.config import DOW_LONG, DOW_SHORT, Profile
from spanwise.functions.scans import ranked
from spanwise.operators.temporal import with_scalars


def timeline_sample(df: DataFrame, per_region: int | None = None, regions=None, as_of=None) -> DataFrame:
    """H1: rows for a timeline: every episode with ``rank_in_region`` (1 = the region's longest; ties by
    start, open episodes last) and ``plot_end`` (open ends -> ``as_of``, by default the latest instant
    in the data).  ``per_region`` keeps the longest so many of each region; nothing depends on the
    total number of rows.

    The rank comes from range splitters over (region, duration, start, end), so neither a region
    with a third of all rows nor many equal durations are sorted in one task.
    """
    d = df.filter(F.col("region").isin(list(regions))) if regions else df
    latest = F.max(F.greatest("started_at", "finished_at")).alias("_latest")
    d = with_scalars(d, d.agg(latest)).select("region", "started_at", "finished_at", "duration_min", "_latest")
    order = [F.desc_nulls_last("duration_min"), F.asc("started_at"), F.asc_nulls_last("finished_at")]
    ranks = ranked(d, ["region"], order, "rank_in_region", "timeline")
    if per_region is not None:
        ranks = ranks.filter(F.col("rank_in_region") <= per_region)
    now = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else F.col("_latest")
    return ranks.select("region", "started_at", "finished_at", "duration_min", "rank_in_region",
                         F.coalesce(F.col("finished_at"), now).alias("plot_end"))


def region_dimension(spark, profile: Profile) -> DataFrame:
    """The region dimension (name, English name, centroid)."""
    return spark.createDataFrame([tuple(r) for r in profile.regions],
                                 "region string, name_en string, lat double, lon double")


def region_metric_map(metric: DataFrame, profile: Profile, value_col: str = "alert_count") -> DataFrame:
    """H2 + H3: every dimension region with its metric and a ``has_data`` flag; centroids attached."""
    dim = region_dimension(metric.sparkSession, profile)
    m = metric.select("region", value_col)
    return dim.join(m, "region", "left").select(
        "region", "name_en", "lat", "lon", value_col, F.col(value_col).isNotNull().alias("has_data")
    )


def weekday_labels(df: DataFrame, col: str = "dow") -> DataFrame:
    """H5: weekday index (0 = Monday) -> short and long label."""
    label = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), F.col(col) + 1)
    return df.withColumns({"dow_short": label(DOW_SHORT), "dow_long": label(DOW_LONG)})
