"""Interval union (episodes) and the uncovered-fine-record test.

Both operators are sequential scans per region in their definition.  A window
partitioned by region alone would put a whole region (possibly a third of the
data) into one task, so both are written as two-level scans:

* rows are first reduced, map-side, to distinct instants per key, so a chunk holds
  at most as many rows as it has instants, however many records share them;
* these are hash-partitioned on ``(key, chunk)`` where ``chunk`` is a fixed
  time bucket of the row's sort instant; a window inside each chunk computes the
  local part of the scan;
* a per-chunk summary table (one row per key and chunk, bounded by
  ``keys x time span / chunk``, independent of row count) carries the state of all
  earlier chunks via a small window, and is joined back on ``(key, chunk)``.

The big side is shuffled once; the summary joins are planned by AQE, which
broadcasts the summary only when its measured size is under the threshold and
otherwise keeps a sort-merge join that reuses the ``(key, chunk)`` partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions import timecols as tc
from spanwise.functions.scans import ranked
from spanwise.functions.stored import write_table

DEFAULT_CHUNK_SECONDS = 3600


_UNB = Window.unboundedPreceding


def merge_intervals(df: DataFrame, key: str = "region", start: str = "started_at", end: str = "finished_at",
                    chunk_seconds: int = DEFAULT_CHUNK_SECONDS, with_count: bool = False) -> DataFrame:
    """Merge overlapping or touching intervals per key into episodes.

    Semantics (sequential definition): order rows of a key by ``(start, end NULLS
    LAST)``; keep a current episode ``(cur_s, cur_e)``.  A row merges when
    ``cur_e`` is not NULL and ``start <= cur_e``; the episode end becomes NULL if
    the row is open, else ``max(cur_e, end)``.  Otherwise the episode is emitted
    and the row starts a new one.  So an open row closes its episode (open), and
    the next row always starts a new episode.

    Parallel form:

    0. closed rows of one start (end >= start) follow each other and always merge, so they
       are one row with the largest end and a record count.  Rows that end before they start
       and open rows may each be an episode of their own: equal ones are counted in the
       shuffle and spread out again after it.
    1. one window pass per ``(key, chunk)`` with no knowledge of earlier chunks:
       ``lseg`` = open rows before the row in the chunk, ``lpm`` = max end of the
       earlier rows of the same ``lseg`` group; a row starts a *local island* iff
       ``lpm`` is NULL or ``start > lpm``.  Rows collapse into islands (fragments).
    2. per chunk: does it hold an open row, and the max end after its last open
       row; a small window over chunks gives ``carry_pm``, the state entering each
       chunk (it resets at open rows).
    3. islands of group ``lseg = 0`` whose start ``<= carry_pm`` continue the
       episode coming from earlier chunks (they form a prefix of the chunk, because
       islands are disjoint and ordered); all other islands start an episode.
    4. continued islands take the label of the last episode start of earlier
       chunks (second small chunk window); the episode is a group-by on label.

    Islands are labelled ``chunk * 2^32 + island number in the chunk`` (chronological),
    so two episodes that share a start (possible only with an open row between them)
    still get different labels.
    """
    s, e = F.col(start), F.col(end)
    own = e.isNull() | (e < s)
    rows = (
        df.filter(F.col(key).isNotNull() & s.isNotNull())
        .groupBy(F.col(key).alias("_k"), s.alias("_s"), own.alias("_own"), F.when(own, e).alias("_oe"))
        .agg(F.max(e).alias("_e"), F.count(F.lit(1)).alias("_m"))
        .select("_k", "_s", "_e", F.explode(
            F.when(F.col("_own"), F.array_repeat(F.lit(1).cast("long"), F.col("_m").cast("int"))).otherwise(F.array("_m"))
        ).alias("_m"))
        .withColumn("_c", tc.time_bucket("_s", chunk_seconds))
        .withColumn("_open", F.col("_e").isNull().cast("int"))
    )
    order = [F.col("_s").asc(), F.col("_e").asc_nulls_last()]
    w_chunk = Window.partitionBy("_k", "_c").orderBy(*order)
    rows = rows.withColumn("_lseg", F.coalesce(F.sum("_open").over(w_chunk.rowsBetween(_UNB, -1)), F.lit(0)))
    rows = rows.withColumn("_topen", F.sum("_open").over(Window.partitionBy("_k", "_c")))
    w_seg = Window.partitionBy("_k", "_c", "_lseg").orderBy(*order).rowsBetween(_UNB, -1)
    rows = rows.withColumn("_lpm", F.max("_e").over(w_seg))
    island_start = F.col("_lpm").isNull() | (F.col("_s") > F.col("_lpm"))
    # island label: chunk * 2^32 + island number inside the chunk -- a long that orders
    # islands chronologically, so every later aggregate is a hash aggregate
    rows = rows.withColumn(
        "_lab",
        F.col("_c") * F.lit(1 << 32) + F.sum(island_start.cast("long")).over(w_chunk.rowsBetween(_UNB, 0)),
    )

    # islands.  Three later steps read different columns of them, so they are written to
    # the shared folder: the windows run once and a lost executor re-reads files.
    frags = write_table(
        rows.groupBy("_k", "_c", "_lab")
        .agg(F.min("_s").alias("_fs"), F.max("_e").alias("_fe"), F.max("_open").alias("_fo"),
             F.sum("_m").alias("_n"), F.max("_lseg").alias("_q"), F.max("_topen").alias("_ft")),
        "islands",
    )

    w_k = Window.partitionBy("_k").orderBy("_c")
    chunks = frags.groupBy("_k", "_c").agg(
        F.max("_fo").alias("_has_open"),
        F.max(F.when(F.col("_q") == F.col("_ft"), F.col("_fe"))).alias("_tail"),
    )
    chunks = chunks.withColumn("_grp", F.sum("_has_open").over(w_k.rowsBetween(_UNB, 0)))
    chunks = chunks.withColumn(
        "_run", F.max("_tail").over(Window.partitionBy("_k", "_grp").orderBy("_c").rowsBetween(_UNB, 0))
    )
    chunks = chunks.select("_k", "_c", F.lag("_run").over(w_k).alias("_carry_pm"))

    j1 = frags.join(chunks, ["_k", "_c"], "left").withColumn(
        "_cont",
        (F.col("_q") == 0) & F.col("_carry_pm").isNotNull() & (F.col("_fs") <= F.col("_carry_pm")),
    )
    owns = j1.groupBy("_k", "_c").agg(F.max(F.when(~F.col("_cont"), F.col("_lab"))).alias("_own"))
    owns = owns.select("_k", "_c", F.max("_own").over(w_k.rowsBetween(_UNB, -1)).alias("_carry_lab"))
    labelled = j1.join(owns, ["_k", "_c"], "left").select(
        "_k", F.when(F.col("_cont"), F.col("_carry_lab")).otherwise(F.col("_lab")).alias("_lab"),
        "_fs", "_fe", "_fo", "_n",
    )
    eps = labelled.groupBy("_k", "_lab").agg(
        F.min("_fs").alias("_fs"), F.max("_fe").alias("_fe"), F.max("_fo").alias("_fo"), F.sum("_n").alias("_n")
    )
    cols = [
        F.col("_k").alias(key),
        F.col("_fs").alias(start),
        F.when(F.col("_fo") == 1, F.lit(None)).otherwise(F.col("_fe")).alias(end),
    ]
    if with_count:
        cols.append(F.col("_n").alias("n_records"))
    out = eps.select(*cols)
    return out.withColumn("duration_min", tc.minutes_between(start, end))


def uncovered_fine(fine: DataFrame, base: DataFrame, cap_seconds: int, key: str = "oblast",
                   chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """Keep fine rows that no base row of the same (raw) key strictly overlaps.

    Definition: fine (s, e) is covered iff some base (bs, be) has ``s < be`` and
    ``e > bs``; a NULL end means start + cap on both sides; fine rows with a NULL
    key are dropped; keys without base rows keep all their fine rows.

    Exact reformulation as an as-of lookup: covered iff
    ``max{be : bs < e} > s`` (prefix max of base ends over base starts strictly
    before the fine row's end).  The prefix max is computed on distinct instants:
    ``(key, base start) -> max base end`` and the distinct ``(key, fine end)``, merged in
    order of (time, fine ends first) and scanned per ``(key, chunk)`` with a carry of the
    max base end of all earlier chunks.  Fine rows then look it up by equality, a join
    that AQE can split; no record is sorted.
    """
    cap_us = int(cap_seconds) * 1_000_000
    end = F.coalesce(F.col("finished_at"), tc.add_micros("started_at", cap_us))
    starts = base.filter(F.col(key).isNotNull()).groupBy(
        F.col(key).alias("_k"), F.col("started_at").alias("_t")
    ).agg(F.max(end).alias("_be")).withColumn("_kind", F.lit(1))
    probed = fine.filter(F.col(key).isNotNull()).withColumn("_t", end)
    ends = probed.select(F.col(key).alias("_k"), "_t").distinct().select(
        "_k", "_t", F.lit(None).cast("timestamp_ntz").alias("_be"), F.lit(0).alias("_kind"))
    stream = starts.select("_k", "_t", "_be", "_kind").unionByName(ends).withColumn("_c", tc.time_bucket("_t", chunk_seconds))
    w = Window.partitionBy("_k", "_c").orderBy("_t", "_kind").rowsBetween(_UNB, 0)
    local = stream.withColumn("_lpm", F.max("_be").over(w)).filter(F.col("_kind") == 0)
    carry = stream.groupBy("_k", "_c").agg(F.max("_be").alias("_cm")).select(
        "_k", "_c",
        F.max("_cm").over(Window.partitionBy("_k").orderBy("_c").rowsBetween(_UNB, -1)).alias("_carry"),
    )
    reach = local.join(carry, ["_k", "_c"], "left").select(
        F.col("_k").alias("_rk"), F.col("_t").alias("_rt"), F.greatest("_lpm", "_carry").alias("_pm"))
    joined = probed.join(reach, (F.col(key) == F.col("_rk")) & (F.col("_t") == F.col("_rt")))
    return joined.filter(F.col("_pm").isNull() | (F.col("_pm") <= F.col("started_at"))).select(*fine.columns)


def with_uncovered(records: DataFrame, cap_seconds: int, key: str = "oblast",
                   chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """P6 + P7 + P8: base rows (oblast / raion) plus the uncovered fine (hromada) rows; rows of
    any other level and fine rows without a key are dropped.  ``records`` is read several
    times, so callers pass a stored table."""
    base = records.filter(F.col("level").isin("oblast", "raion"))
    fine = records.filter(F.col("level") == "hromada")
    return base.unionByName(uncovered_fine(fine, base, cap_seconds, key, chunk_seconds))


def in_start_order(eps: DataFrame) -> DataFrame:
    """Episodes with their ``position`` (from 1) by start, ties by region, then end (open last), from
    range splitters over all three: no task sorts a day, or an instant, of all regions."""
    order = [F.asc("started_at"), F.asc("region"), F.asc_nulls_last("finished_at")]
    return ranked(eps, [], order, "position", "episodes-ordered")
