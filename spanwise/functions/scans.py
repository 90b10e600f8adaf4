"""Two-level running aggregates (prefix sums / maxima) and exact ranks without a single-partition window.

A running aggregate over rows ordered within ``keys`` is computed as
``local running value inside (keys, bucket)`` combined with ``the aggregate of all
earlier buckets`` (from a table with one row per bucket, a small window over it and
a join).  ``bucket`` must be monotone in the order (e.g. ``floor(t / width)``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.stored import write_table

_UNB = Window.unboundedPreceding
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: list[str], bucket: str, order: list, specs: list[tuple[str, str, str]],
            descending: bool = False) -> DataFrame:
    """Add running aggregates (inclusive of the current row).

    ``specs``: ``(output, input column, "sum" | "max" | "min")``.  ``order`` sorts rows inside a bucket in
    the scan direction; buckets are visited ascending (or descending with ``descending=True``).
    """
    w_local = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(_UNB, 0)
    out = df
    for name, col, how in specs:
        out = out.withColumn(name, _AGG[how](col).over(w_local))
    totals = df.groupBy(*keys, bucket).agg(*[_AGG[how](col).alias(f"_tot_{name}") for name, col, how in specs])
    b_order = F.col(bucket).desc() if descending else F.col(bucket).asc()
    w_b = Window.partitionBy(*keys).orderBy(b_order).rowsBetween(_UNB, -1)
    offs = totals.select(
        *keys, bucket,
        *[_AGG[how](f"_tot_{name}").over(w_b).alias(f"_off_{name}") for name, _, how in specs],
    )
    out = out.join(offs, [*keys, bucket], "left")
    for name, _, how in specs:
        off = F.col(f"_off_{name}")
        if how == "sum":
            combined = F.col(name) + F.coalesce(off, F.lit(0))
        else:
            combined = (F.greatest if how == "max" else F.least)(F.col(name), off)
        out = out.withColumn(name, combined).drop(f"_off_{name}")
    return out


def next_in_order(df: DataFrame, keys: list[str], bucket: str, order_col: str, cols: list[str]) -> DataFrame:
    """Add ``_next_<c>`` = value of ``c`` on the next row by ``order_col`` (ascending, unique per key).

    Inside a bucket this is ``lead``; the last row of a bucket takes the first row of the
    next non-empty bucket, found on the bucket table (one row per bucket).
    """
    w = Window.partitionBy(*keys, bucket).orderBy(order_col)
    out = df
    for c in cols:
        out = out.withColumn(f"_next_{c}", F.lead(c).over(w))
    firsts = df.groupBy(*keys, bucket).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col)).alias("_f"))
    wb = Window.partitionBy(*keys).orderBy(bucket)
    firsts = firsts.select(*keys, bucket, F.lead("_f").over(wb).alias("_nf"))
    out = out.join(firsts, [*keys, bucket], "left")
    for c in cols:
        out = out.withColumn(f"_next_{c}", F.coalesce(F.col(f"_next_{c}"), F.col("_nf")[c]))
    return out.drop("_nf")


def ranked(df: DataFrame, keys: list[str], order: list, out: str, name: str = "ranked") -> DataFrame:
    """Add ``out`` = exact row number (from 1) within ``keys`` by ``order``, by range splitters.

    Rows are range partitioned on the full sort key (sampled splitters), sorted and numbered
    where they lie; a range's numbers are shifted by the counts of the ranges before it (one row per key
    and range).  Rows that tie in everything are split between ranges by their place in the input, so no
    key, bucket or tie is ever sorted in one task.  The sorted rows are written once: the numbers are read back
    with the rows they belong to, whatever is recomputed later.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(k).asc() for k in keys] + order + [F.col("_tie").asc()]
    lying = tied.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie")
    lying = write_table(lying.withColumn("_at", F.monotonically_increasing_id()), name)
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = lying.groupBy(*keys, part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min(row).alias("_first"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(_UNB, -1)), F.lit(0))
    shift = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
                          (before - F.col("_first") + 1).alias("_shift"))
    same = part == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return lying.join(shift, same).select(*df.columns, (row + F.col("_shift")).alias(out))
