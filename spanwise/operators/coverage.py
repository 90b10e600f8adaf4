"""Per-episode unit coverage (G1).

For each episode: the number of distinct units (level-scoped locations) active
during it, and that number over the distinct units ever seen in the region.

* closed episode: unit record overlaps iff ``u.start < ep.end`` and
  ``coalesce(u.end, as_of) > ep.start`` (strict);
* open episode: every unit record with ``u.start >= ep.start``.

Closed episodes are counted without joining them to records:

1. A unit's records in order of start; one that ends no later than an earlier one can meet no episode
   that the earlier one does not, so it is dropped.  Starts and ends of the others rise together, hence the
   records that meet an episode follow each other: units = records that meet it, minus pairs of
   neighbours that both meet it.  One running maximum of ends per unit gives both.
2. Records and pairs are points (p, q) that count iff ``p < ep.end`` and ``q > ep.start`` (a record: its start
   and end; a pair: the later start and the earlier end).  Where p <= q that is a difference
   of two counts, ``#{p < ep.end} - #{q <= ep.start}``: running sums over time, read off at the episodes' ends.
3. A pair with a gap (q < p) counts iff the gap lies inside the episode: it is assigned to the last
   episode that starts before the gap by an as-of lookup.  Episodes of the union are disjoint, so that is
   the only one.  Of episodes that may overlap, any may enclose it: such gaps meet them by a join on time bins.

Open episodes: the region's units without those whose latest start lies before it, from the same scan.
All scans run per chunk of time with a carry (two levels); no episode x record row is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions import timecols as tc
from spanwise.functions.scans import running
from spanwise.functions.stored import write_table

DEFAULT_BIN_SECONDS = 3600
CHUNK_SECONDS = 86_400
UNIT_CHUNK_SECONDS = 30 * 86_400  # of the scan per unit: a unit has few records a day
_UNB = Window.unboundedPreceding
_FOREVER = 1 << 62  # end of a record that is still running


def _chunk(c: str, seconds: int = CHUNK_SECONDS) -> F.Column:
    return F.floor(F.col(c) / F.lit(seconds * 1_000_000)).cast("long")


def _points(records: DataFrame) -> DataFrame:
    """(region, p, q, w) of the records that count and of their neighbour pairs (w = -1), from
    records (region, unit_name, us, ue) in microseconds; see the module text."""
    keys = ["region", "unit_name"]
    r = records.groupBy(*keys, "us").agg(F.max("ue").alias("ue")).withColumn("_b", _chunk("us", UNIT_CHUNK_SECONDS))
    earlier = F.max("ue").over(Window.partitionBy(*keys, "_b").orderBy("us").rowsBetween(_UNB, -1))
    chunks = r.groupBy(*keys, "_b").agg(F.max("ue").alias("_max"))
    carried = chunks.select(*keys, "_b", F.max("_max").over(
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(_UNB, -1)).alias("_carry"))
    r = r.withColumn("_local", earlier).join(carried, [*keys, "_b"]).withColumn("_before", F.greatest("_local", "_carry"))
    front = r.filter(F.col("_before").isNull() | (F.col("ue") > F.col("_before")))
    own = F.struct(F.col("us").alias("p"), F.col("ue").alias("q"), F.lit(1).alias("w"))
    pair = F.struct(F.col("us").alias("p"), F.col("_before").alias("q"), F.lit(-1).alias("w"))
    return front.select("region", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, pair))).alias("_p")).select(
        "region", "_p.*")


def _read_off(points: DataFrame, last: DataFrame, eps: DataFrame, totals: DataFrame, disjoint: bool) -> DataFrame:
    """One scan per region over points, latest starts and episode ends.  Rows of two kinds: (region, s, e, n) is a
    part of an episode's count; unless the episodes are disjoint, a gap (q, p) inside some episode comes back
    with its weight n, for ``_in_overlapping``.

    At one instant: ends of episodes, open episodes and gaps first, then points, then episode starts; a record
    without length does not meet an episode of that same instant, so starts of empty episodes precede it."""
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    w, empty = F.col("w").cast("long"), F.col("p") == F.col("q")
    row = lambda t, o, f=zero, g=zero, p=none, w=none: F.struct(
        t.alias("t"), o.alias("o"), f.alias("f"), g.alias("g"), p.alias("p"), w.alias("w"))
    place = F.when(empty, 3).otherwise(1)
    wide = F.array(row(F.col("p"), place, f=w), row(F.col("q"), place, g=w))
    gap = F.array(row(F.col("q"), F.lit(0), p=F.col("p"), w=w))
    events = points.select("region", F.explode(F.when(F.col("p") <= F.col("q"), wide).otherwise(gap)).alias("_e")).select(
        "region", "_e.*", zero.alias("h"))
    latest = last.select("region", F.col("us").alias("t"), F.lit(1).alias("o"), F.lit(1).cast("long").alias("h"), zero.alias("f"), zero.alias("g"))
    events = events.unionByName(latest, allowMissingColumns=True).groupBy("region", "t", "o", "p").agg(
        *[F.sum(c).alias(c) for c in ("f", "g", "h", "w")])
    end = lambda t, o, s, e: F.struct(t.alias("t"), o.alias("o"), s.alias("_s"), e.alias("_e"))
    s, e = F.col("s"), F.col("e")
    ends = F.when(e.isNull(), F.array(end(s, F.lit(0), none, none))).otherwise(
        F.array(end(e, F.lit(0), none, none), end(s, F.when(s == e, 2).otherwise(4), s, e)))
    probes = eps.select("region", "s", "e", F.explode(ends).alias("_x")).select(
        "region", "s", "e", "_x.*", zero.alias("f"), zero.alias("g"), zero.alias("h"))
    # the scan reads its rows twice, for the running values and for the chunks' totals
    line = write_table(events.unionByName(probes, allowMissingColumns=True).withColumn("_b", _chunk("t")), "coverage-line")
    line = running(line, ["region"], "_b", [F.asc("t"), F.asc("o")], [
        ("_f", "f", "sum"), ("_g", "g", "sum"), ("_h", "h", "sum"), ("_ls", "_s", "max"), ("_le", "_e", "max")])
    of_episode, enclosed = s.isNotNull(), F.col("p") < F.col("_le")  # by an episode that starts before the gap
    # an open episode: the region's units without those whose latest start lies before it
    counted = F.when(e.isNull(), F.coalesce("_tot", zero) - F.col("_h")).when(F.col("o") == 0, F.col("_f")).otherwise(-F.col("_g"))
    kept = line.filter(of_episode | enclosed).join(totals, "region", "left")
    sole = enclosed & F.lit(disjoint)
    return kept.select("region", F.when(of_episode, s).when(sole, F.col("_ls")).alias("s"),
                       F.when(of_episode, e).when(sole, F.col("_le")).alias("e"),
                       F.when(of_episode, counted).otherwise(F.col("w")).alias("n"), "p", F.col("t").alias("q"))


def _in_overlapping(gaps: DataFrame, closed: DataFrame, bin_us: int) -> DataFrame:
    """(region, s, e, n): gaps and all episodes that enclose them, by an equi-join on time bins."""
    bins = F.explode(F.sequence(F.floor(F.col("s") / bin_us).cast("long"), F.floor(F.col("e") / bin_us).cast("long")))
    met = gaps.select("region", "p", "q", "n", F.floor(F.col("q") / bin_us).cast("long").alias("_b")).join(
        closed.select("region", "s", "e", bins.alias("_b")), ["region", "_b"])
    return met.filter((F.col("s") < F.col("q")) & (F.col("p") < F.col("e"))).select("region", "s", "e", "n")


def episode_unit_coverage(units: DataFrame, episodes: DataFrame, as_of=None,
                          bin_seconds: int = DEFAULT_BIN_SECONDS, disjoint: bool = False) -> DataFrame:
    """G1: episodes + ``unit_count`` (int) + ``unit_fraction`` (4 dp).

    ``as_of`` replaces the wall clock for open unit records; ``None`` means an open
    record is still running (later than every episode start).  ``disjoint``: the closed episodes of a region
    do not overlap (those of the union never do), which is not checked.  Otherwise gaps that lie inside
    some episode are joined to all of them on time bins of ``bin_seconds``.
    """
    u = units.filter(F.col("region").isNotNull() & F.col("started_at").isNotNull())
    now = F.lit(_FOREVER) if as_of is None else tc.epoch_micros(F.lit(as_of).cast("timestamp_ntz"))
    records = u.select("region", "unit_name", tc.epoch_micros("started_at").alias("us"),
                       F.coalesce(tc.epoch_micros("finished_at"), now).alias("ue"))
    records = records.filter(F.col("unit_name").isNotNull())
    last = records.groupBy("region", "unit_name").agg(F.max("us").alias("us"))
    totals = last.groupBy("region").agg(F.count(F.lit(1)).alias("_tot"))
    eps = episodes.select("region", tc.epoch_micros("started_at").alias("s"), tc.epoch_micros("finished_at").alias("e")).distinct()
    eps = eps.filter(F.col("region").isNotNull() & F.col("s").isNotNull())
    met = _read_off(_points(records), last, eps, totals, disjoint)
    if not disjoint:
        met = write_table(met, "coverage")
        met = met.filter(F.col("p").isNull()).select("region", "s", "e", "n").unionByName(
            _in_overlapping(met.filter(F.col("p").isNotNull()), eps.filter(F.col("e").isNotNull()), int(bin_seconds) * 1_000_000))
    counts = met.groupBy("region", "s", "e").agg(F.sum("n").alias("unit_count"))
    c = counts.select(F.col("region").alias("_r"), "s", "e", "unit_count")
    key = (F.col("region") == F.col("_r")) & (tc.epoch_micros("started_at") == F.col("s")) & tc.epoch_micros("finished_at").eqNullSafe(F.col("e"))
    out = episodes.join(c, key, "left").join(totals, "region", "left")
    unit_count = F.coalesce(F.col("unit_count"), F.lit(0)).cast("long")
    return out.select(
        *episodes.columns,
        unit_count.alias("unit_count"),
        F.bround(unit_count / F.coalesce(F.col("_tot"), F.lit(1)), 4).alias("unit_fraction"),
    )
