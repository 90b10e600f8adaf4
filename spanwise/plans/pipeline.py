"""Ingest plan: raw records -> unit records -> episodes -> analysis frame.

Two steps run when the plan is built, because several later steps read their result:
the cleaned records (``unit_records``) and the local islands of the interval union are
written to the shared folder and read back.  The rest is lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession

from spanwise.config import Profile
from spanwise.functions.stored import write_table
from spanwise.operators import clean, temporal, unify


def unit_records(raw: DataFrame, profile: Profile, chunk_seconds: int = unify.DEFAULT_CHUNK_SECONDS,
                 report: dict[str, int] | None = None) -> DataFrame:
    """Per-unit records before the union.

    Columns: oblast, raion, hromada, level, started_at, finished_at, region, unit_name.
    ``report`` is filled with the load's counters (P3-P5), taken as the records are written.
    """
    # one scan and one dedup shuffle of the raw rows; P7 reads the written records several times
    seen = (Observation(), Observation())
    records = write_table(clean.prepare_records(raw, profile, seen), "records")
    if report is not None:
        report.update(clean.ingest_report(seen))
    # Base rows + uncovered fine rows
    units = unify.with_uncovered(records, profile.cap_seconds, key="oblast", chunk_seconds=chunk_seconds)
    units = clean.canonical_region(units, profile.aliases)  # P9
    units = clean.unit_name(units)  # P10
    return clean.exclude_regions(units, profile.excluded)  # P11 (before the union)


def unit_projection(units: DataFrame) -> DataFrame:
    """The public unit-record table."""
    return units.select("region", "unit_name", "level", "started_at", "finished_at")


def episodes(raw: DataFrame, profile: Profile, chunk_seconds: int = unify.DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """Region, started_at, finished_at, duration_min."""
    units = unit_records(raw, profile, chunk_seconds)
    return episodes_from_units(units, chunk_seconds)


def episodes_from_units(units: DataFrame, chunk_seconds: int = unify.DEFAULT_CHUNK_SECONDS) -> DataFrame:
    return unify.merge_intervals(units.select("region", "started_at", "finished_at"), chunk_seconds=chunk_seconds)


def analysis_frame(eps: DataFrame, profile: Profile, exclude_permanent: bool = True) -> DataFrame:
    """T5: canonical names, censor flag, duration, optional exclusion, local calendar features."""
    return temporal.prepare(eps, profile, exclude_permanent=exclude_permanent)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
