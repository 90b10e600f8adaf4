"""Record cleaning: headers, dedup, parsing, cap, level split, canonical names.

All steps are narrow (no shuffle) except the exact dedup, which hashes on the six
raw text columns once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spanwise.config import LEVEL_FINE, LEVELS_BASE, RAW_NULL_TOKENS, Profile
from spanwise.functions import timecols as tc

RAW_KEY = ["oblast", "raion", "hromada", "level", "started_at", "finished_at"]
RAW_REQUIRED = set(RAW_KEY)


def normalise_headers(df: DataFrame) -> DataFrame:
    """Strip and lower-case every column name."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def require_columns(df: DataFrame, required: Iterable[str], where: str = "input") -> DataFrame:
    """Raise when a required column is missing (schema check, no job)."""
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"[{where}] missing expected columns: {sorted(missing)}")
    return df


def null_tokens(df: DataFrame, columns: Iterable[str] | None = None, tokens=RAW_NULL_TOKENS) -> DataFrame:
    """Map the textual NA markers of the raw files to NULL."""
    cols = set(columns or df.columns)
    return df.select(
        *[F.when(F.col(c).isin(list(tokens)), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
          if c in cols else F.col(c) for c in df.columns]
    )


def dedup_raw(df: DataFrame) -> DataFrame:
    """Exact duplicates on the six raw text columns (``source`` ignored, NULLs equal).

    Returns the six key columns only: a plain ``distinct`` keeps the aggregate a
    hash aggregate with map-side combine (carrying ``source`` along would force a
    sort-based ``first`` aggregate), and nothing downstream reads ``source``.
    """
    return df.select(*RAW_KEY).distinct()


def cap_duration(df: DataFrame, cap_seconds: int) -> DataFrame:
    """P5: a closed record longer than the cap (strictly) ends at start + cap; open rows untouched."""
    too_long = F.col("finished_at").isNotNull() & (
        tc.micros_between("started_at", "finished_at") > F.lit(int(cap_seconds) * 1_000_000)
    )
    return df.withColumn(
        "finished_at", F.when(too_long, tc.add_seconds("started_at", cap_seconds)).otherwise(F.col("finished_at"))
    )


def split_levels(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base = oblast/raion, fine = hromada); any other level is dropped."""
    return df.filter(F.col("level").isin(LEVELS_BASE)), df.filter(F.col("level") == LEVEL_FINE)


def alias_map_column(aliases: dict) -> F.Column:
    items = []
    for k in sorted(aliases):
        items += [F.lit(k), F.lit(aliases[k])]
    return F.create_map(*items) if items else F.create_map().cast("map<string,string>")


def canonical_region(df: DataFrame, aliases: dict, src: str = "oblast", dst: str = "region") -> DataFrame:
    """Variant spelling -> canonical name; unknown names pass through, NULL stays NULL.

    The alias table is a fixed-size literal map, evaluated JVM-side per row (no join).
    """
    mapped = F.try_element_at(alias_map_column(aliases), F.col(src))
    return df.withColumn(dst, F.coalesce(mapped, F.col(src)))


def unit_name(df: DataFrame) -> DataFrame:
    """P10: level-scoped unit id: region | region::district | region::locality (NULL part -> '')."""
    region = F.coalesce(F.col("region"), F.lit(""))
    level = F.coalesce(F.col("level"), F.lit("oblast"))
    return df.withColumn(
        "unit_name",
        F.when(level == "oblast", region)
        .when(level == "raion", F.concat(region, F.lit("::"), F.coalesce(F.col("raion"), F.lit(""))))
        .otherwise(F.concat(region, F.lit("::"), F.coalesce(F.col("hromada"), F.lit("")))),
    )


def exclude_regions(df: DataFrame, excluded: Iterable[str], col: str = "region") -> DataFrame:
    """Drop near-permanent regions (NULL region is kept, as a NULL never matches)."""
    ex = list(excluded)
    if not ex:
        return df
    return df.filter(F.col(col).isNull() | ~F.col(col).isin(ex))


def filter_region_date(df: DataFrame, regions=None, start=None, end=None, tz: str | None = None,
                       date_col: str = "date") -> DataFrame:
    """Region in list (empty = all) and local date in [start, end] when both bounds are given."""
    out = df
    if regions:
        out = out.filter(F.col("region").isin(list(regions)))
    if start is not None and end is not None:
        d = F.col(date_col) if date_col in df.columns else F.to_date(tc.to_local("started_at", tz))
        out = out.filter(d.between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
    return out


def dedup_parse(df: DataFrame, seen: Observation | None = None) -> DataFrame:
    """P3 + P4: distinct raw text rows, then instants parsed per row; rows without a start dropped.

    The dedup is a plain hash aggregate on the six text columns (map-side combine
    of the duplicate copies).  The outputs are tied to the group's row count
    (``copies > 0`` always holds), so Catalyst keeps the parse and the filters of
    later steps after the shuffle: the parse runs once per distinct row, in
    parallel over the shuffle partitions.  As a bare projection, the filters would
    be pushed below the aggregate into the source projection (parsing every raw
    copy in one oversized expression, and splitting the scan per consumer).

    ``seen`` observes raw rows, distinct rows and distinct rows without a readable start as they pass.
    """
    g = df.groupBy(*RAW_KEY).agg(F.count(F.lit(1)).alias("_copies"))
    kept = F.col("_copies") > 0
    # applying the zone offset never turns a parsed value into NULL: filter on the cheap cast
    readable = F.when(kept, F.col("started_at").try_cast("timestamp_ntz")).isNotNull()
    if seen is not None:
        g = g.observe(seen, F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_raw"), F.count(F.lit(1)).alias("n_distinct"),
                      F.count_if(~readable).alias("n_bad_start"))
    g = g.filter(readable)
    return g.select(
        *[F.when(kept, F.col(c)).alias(c) for c in ("oblast", "raion", "hromada", "level")],
        F.when(kept, tc.parse_instant("started_at")).alias("started_at"),
        F.when(kept, tc.parse_instant("finished_at")).alias("finished_at"),
    )


def prepare_records(raw: DataFrame, profile: Profile, seen: tuple[Observation, Observation] | None = None) -> DataFrame:
    """S1 output -> parsed, capped records (P1-P5), all levels.  ``seen``: observations of what is deduplicated
    and dropped, and of what is capped; ``ingest_report`` reads them after the records were written."""
    df = require_columns(normalise_headers(raw), RAW_REQUIRED, "load")
    rows = dedup_parse(df, seen and seen[0])
    if seen is not None:
        long = tc.micros_between("started_at", "finished_at") > F.lit(int(profile.cap_seconds) * 1_000_000)
        rows = rows.observe(seen[1], F.count_if(F.coalesce(long, F.lit(False))).alias("n_capped"))
    return cap_duration(rows, profile.cap_seconds)


def ingest_report(seen: tuple[Observation, Observation]) -> dict[str, int]:
    """P3-P5 counters of the load that wrote the records: raw rows, distinct rows, distinct rows without a readable
    start (dropped), and kept rows whose end was cut to start + cap."""
    return {k: int(v) for o in seen for k, v in o.get.items()}


def ingest_counts(raw: DataFrame, profile: Profile) -> DataFrame:
    """P3-P5 counters, one row: raw rows, distinct rows, distinct rows without a readable start
    (dropped), and kept rows whose end was cut to start + cap.  For raw rows that are not loaded; a load reports them
    itself (``ingest_report``)."""
    g = normalise_headers(raw).groupBy(*RAW_KEY).agg(F.count(F.lit(1)).alias("_copies"))
    start = tc.parse_instant("started_at")
    long = tc.micros_between(start, tc.parse_instant("finished_at")) > F.lit(profile.cap_seconds * 1_000_000)
    return g.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_raw"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.count_if(start.isNull()).alias("n_bad_start"),
        F.count_if(F.coalesce(long, F.lit(False))).alias("n_capped"),
    )
