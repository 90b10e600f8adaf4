"""Two-source reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.config import Profile
from spanwise.functions import timecols as tc
from spanwise.operators import clean


def second_source(raw: DataFrame, profile: Profile) -> DataFrame:
    """Whole-row dedup, canonical region, strict UTC parse (bad text raises),
    keep starts on or after the official start."""
    # whole-row dedup; outputs tied to the group count keep the parse and the date filter
    # after the shuffle (parallel, once per distinct row) instead of inside the scan
    g = raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_copies"))
    d = g.select(*[F.when(F.col("_copies") > 0, F.col(c)).alias(c) for c in raw.columns])
    d = clean.canonical_region(d, profile.aliases, src="region", dst="region")
    parsed = tc.parse_instant("started_at")
    strict = F.when(parsed.isNull() & F.col("started_at").isNotNull(),
                    F.raise_error(F.concat(F.lit("unparseable started_at: "), F.col("started_at")))).otherwise(parsed)
    d = d.withColumn("started_at", strict.cast("timestamp_ntz"))
    return d.filter(F.col("started_at") >= F.lit(profile.official_start + " 00:00:00").cast("timestamp_ntz"))


def compare_sources(episodes: DataFrame, second: DataFrame, profile: Profile) -> DataFrame:
    """Episodes vs second-source rows per region, full outer, 0-filled, excluded
    regions dropped, ``ratio_off_vol = official / max(volunteer -> 1 if 0)`` (2 dp)."""
    off = clean.canonical_region(episodes, profile.aliases, src="region", dst="region")
    oc = off.filter(F.col("region").isNotNull()).groupBy("region").agg(F.count(F.lit(1)).alias("official"))
    vc = second.filter(F.col("region").isNotNull()).groupBy("region").agg(F.count(F.lit(1)).alias("volunteer"))
    cmp = oc.join(vc, "region", "full_outer").select(
        "region",
        F.coalesce("official", F.lit(0)).cast("long").alias("official"),
        F.coalesce("volunteer", F.lit(0)).cast("long").alias("volunteer"),
    )
    cmp = clean.exclude_regions(cmp, profile.excluded).filter(F.col("region").isNotNull())
    denom = F.when(F.col("volunteer") == 0, F.lit(1)).otherwise(F.col("volunteer"))
    return cmp.withColumn("ratio_off_vol", F.bround(F.col("official") / denom, 2)).orderBy(F.desc("official"), "region")


def _avg_rank(df: DataFrame, col: str) -> F.Column:
    w = Window.orderBy(col)  # the comparison table has one row per region
    ties = Window.partitionBy(col)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def source_spearman(cmp: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Spearman rho between the two per-region counts (average ranks), verdict rho >= 0.8.

    The rank windows run over the per-region table (one row per region)."""
    r = cmp.select(_avg_rank(cmp, "official").alias("x"), _avg_rank(cmp, "volunteer").alias("y"))
    s = r.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"),
    )
    num = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    den = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2))
    rho = F.when(den > 0, num / den)
    return s.select(F.bround(rho, 6).alias("rho"), F.coalesce(rho >= threshold, F.lit(False)).alias("agree"))
