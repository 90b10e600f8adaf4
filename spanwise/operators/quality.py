"""Data-quality checks on episodes (V1-V8): one aggregation pass and a report table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.config import Profile
from spanwise.functions import timecols as tc
from spanwise.operators import clean

REQUIRED = ["region", "started_at", "finished_at", "duration_min"]
RAISE, WARN = "raise", "warn"


def region_gaps(eps: DataFrame, profile: Profile) -> DataFrame:
    """V6: (kind, region) — 'unknown' = found after aliasing, not in the dimension nor excluded;
    'missing' = in the dimension, not excluded, never found."""
    found = clean.canonical_region(eps.select("region").filter(F.col("region").isNotNull()).distinct(),
                                   profile.aliases, src="region", dst="region").distinct()
    dim = eps.sparkSession.createDataFrame([(r,) for r in profile.region_names], "region string")
    excl = eps.sparkSession.createDataFrame([(r,) for r in profile.excluded] or [("",)], "region string")
    unknown = found.join(F.broadcast(dim), "region", "left_anti").join(F.broadcast(excl), "region", "left_anti")
    missing = dim.join(F.broadcast(excl), "region", "left_anti").join(found, "region", "left_anti")
    return unknown.select(F.lit("unknown").alias("kind"), "region").unionByName(
        missing.select(F.lit("missing").alias("kind"), "region"))


def quality_report(eps: DataFrame, profile: Profile) -> DataFrame:
    """V1-V8 (+P16 open-interval count): rows (check, severity, n_bad, passed) in the original order.

    V1 counts the required columns that are missing (no job); they are read as NULL by the other checks, and
    ``assert_valid`` raises.  V2-V5 and V7 come from one aggregate pass (duplicates from one group-by on the key),
    V6 from ``region_gaps``.
    """
    absent = [c for c in REQUIRED if c not in eps.columns]
    kinds = {"region": "string", "duration_min": "double"}
    eps = eps.withColumns({c: F.lit(None).cast(kinds.get(c, "timestamp_ntz")) for c in absent}) if absent else eps
    complete = F.col("started_at").isNotNull() & F.col("finished_at").isNotNull()
    official = F.lit(profile.official_start + " 00:00:00").cast("timestamp_ntz")
    one = eps.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(complete & (tc.micros_between("started_at", "finished_at") < 0)).alias("n_order"),
        F.count_if(F.col("duration_min").isNotNull() & (F.col("duration_min") < 0)).alias("n_neg"),
        F.count_if(F.col("duration_min").isNotNull() & (F.col("duration_min") == 0)).alias("n_zero"),
        F.count_if(F.col("started_at") < official).alias("n_early"),
        F.count_if(F.col("finished_at").isNull()).alias("n_open"),
    )
    dups = eps.groupBy("region", "started_at", "finished_at").agg(F.count(F.lit(1)).alias("_c")).agg(
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n_dup"))
    gaps = region_gaps(eps, profile).groupBy().agg(
        F.count_if(F.col("kind") == "unknown").alias("n_unknown"),
        F.count_if(F.col("kind") == "missing").alias("n_missing"),
    )
    from spanwise.operators.temporal import with_scalars
    wide = with_scalars(with_scalars(one, dups), gaps)
    n_low = F.when(F.col("n_rows") < profile.min_rows, F.col("n_rows")).otherwise(F.lit(0))
    checks = [
        ("schema", RAISE, F.lit(len(absent))),
        ("row_count", RAISE, n_low),
        ("date_order", RAISE, F.col("n_order")),
        ("negative_duration", RAISE, F.col("n_neg")),
        ("zero_duration", WARN, F.col("n_zero")),
        ("duplicates", RAISE, F.col("n_dup")),
        ("unknown_regions", WARN, F.col("n_unknown")),
        ("missing_regions", WARN, F.col("n_missing")),
        ("coverage_start", WARN, F.col("n_early")),
        ("open_intervals", WARN, F.col("n_open")),  # P16
    ]
    items = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("check"), F.lit(sev).alias("severity"),
                 c.cast("long").alias("n_bad"))
        for i, (n, sev, c) in enumerate(checks)
    ])
    return wide.select(F.inline(items)).withColumn("passed", F.col("n_bad") == 0)


def assert_valid(report: DataFrame) -> None:
    """Raise on failed 'raise' checks (the report is a handful of rows)."""
    bad = report.filter((F.col("severity") == RAISE) & ~F.col("passed")).select("check", "n_bad").collect()
    if bad:
        raise ValueError("[validation] failed: " + ", ".join(f"{r['check']}={r['n_bad']}" for r in bad))
