"""Wide matrices from long results, at the presentation edge."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_matrix(long: DataFrame, row: str, column: str, value: str, values: Iterable, name: Callable = str) -> DataFrame:
    """One row per ``row``, one column per entry of ``values`` (a fixed list: a dimension or the calendar, never read from
    the data), named ``name(entry)``; NULL where the long result has no such cell."""
    values = list(values)
    wide = long.groupBy(row).pivot(column, values).agg(F.first(value))
    return wide.select(row, *[F.col(f"`{v}`").alias(name(v)) for v in values])


def transposed(wide: DataFrame, row: str, rows: Iterable, label: str = "column") -> DataFrame:
    """The matrix with its columns as rows: (``label``, one column per entry of ``rows``)."""
    columns = [c for c in wide.columns if c != row]
    cells = wide.select(row, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("v")) for c in columns])).alias("x"))
    return to_matrix(cells.select(row, F.col("x.c").alias(label), F.col("x.v").alias("v")), label, row, "v", rows)
