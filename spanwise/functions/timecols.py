"""Column expressions for instants.

Convention: every instant column is ``TIMESTAMP_NTZ`` holding UTC wall-clock
time.  Nothing here reads the session time zone, so results do not depend on
``spark.sql.session.timeZone``.  Local (calendar) values are derived with
``convert_timezone`` and are never used for durations or ordering, because two
UTC instants can map to the same local value in the autumn fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "1970-01-01 00:00:00"

# zone offset after a clock time: +HH, +HH:MM or +HHMM (Z and no offset mean UTC)
_OFFSET = r"\d:\d\d(?::\d\d(?:\.\d+)?)?\s*([+-]\d\d(?::?\d\d)?)\s*$"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_ntz() -> Column:
    return F.lit(_EPOCH).cast("timestamp_ntz")


def parse_instant(c) -> Column:
    """Parse text to a UTC instant, NULL when the text is not a timestamp.

    Each row is parsed on its own (mixed formats in one column are fine): the
    wall-clock part by ``try_cast`` to TIMESTAMP_NTZ (which reads the ISO forms
    and ignores a zone suffix), the offset by one small regex on the tail and
    applied explicitly, so the session time zone plays no part.  Text without an
    offset (or with ``Z``) is UTC.  Kept small on purpose: it runs twice per raw
    record inside whole-stage code generation.
    """
    s = col_of(c).cast("string")
    local = s.try_cast("timestamp_ntz")
    zone = F.regexp_extract(s, _OFFSET, 1)
    hh = F.substring(zone, 2, 2).try_cast("int")
    mm = F.coalesce(F.substring(F.replace(zone, F.lit(":"), F.lit("")), 4, 2).try_cast("int"), F.lit(0))
    minutes = (hh * 60 + mm) * F.when(F.substring(zone, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    return F.when(zone == "", local).otherwise(F.timestamp_add("MINUTE", -minutes, local))


def epoch_micros(c) -> Column:
    return F.timestamp_diff("MICROSECOND", epoch_ntz(), col_of(c))


def micros_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", col_of(start), col_of(end))


def minutes_between(start, end) -> Column:
    """Exact elapsed minutes as double (integer microseconds divided once)."""
    return micros_between(start, end).cast("double") / F.lit(60_000_000.0)


def add_seconds(c, seconds) -> Column:
    n = seconds if isinstance(seconds, Column) else F.lit(int(seconds))
    return F.timestamp_add("SECOND", n, col_of(c))


def add_micros(c, micros) -> Column:
    n = micros if isinstance(micros, Column) else F.lit(int(micros))
    return F.timestamp_add("MICROSECOND", n, col_of(c))


def to_local(c, tz: str) -> Column:
    """UTC instant -> local wall-clock time (NTZ) in ``tz``, DST-aware."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), col_of(c))


def from_local(c, tz: str) -> Column:
    """Local wall-clock time in ``tz`` -> UTC instant (NTZ)."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), col_of(c))


def time_bucket(c, seconds: int) -> Column:
    """Integer index of the fixed-width bucket holding the instant (floor)."""
    return F.floor(epoch_micros(c) / F.lit(int(seconds) * 1_000_000)).cast("long")


def bucket_start(index: Column, seconds: int) -> Column:
    return add_micros(epoch_ntz(), index * F.lit(int(seconds) * 1_000_000))
