"""Cross-region analytics (C1-C7), long-form outputs.

None of these uses a range self-join or a global sort of raw rows:

* windowed co-occurrence uses a *cell* table — starts are bucketed into cells as
  wide as the window, reduced to ``(region, cell) -> min/max start`` and joined on
  cell ± 1, so the work is linear in starts x active regions;
* wave candidates come from a running count of regions over begins and ends;
* correlations work on per-day / per-hour count tables whose size is bounded by
  the time span, not by the row count;
* the greedy wave chain is composed from per-chunk transitions (entry state ->
  exit state), in a fixed number of jobs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions import timecols as tc
from spanwise.functions.scans import next_in_order, running
from spanwise.functions.stored import write_table
from spanwise.operators.temporal import active_cells, series_bounds

_UNB = Window.unboundedPreceding
SALTS = 8  # copies of a time cell's region table in the co-occurrence join


def _starts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("region").isNotNull() & F.col("started_at").isNotNull()).select(
        "region", "started_at", tc.epoch_micros("started_at").alias("_us")
    )


def _cell_stats(starts: DataFrame, cell_us: int) -> DataFrame:
    return starts.groupBy("region", F.floor(F.col("_us") / F.lit(cell_us)).cast("long").alias("_cell")).agg(
        F.min("_us").alias("_min"), F.max("_us").alias("_max")
    )


def pair_up(left: DataFrame, right: DataFrame, slices: int = 16) -> DataFrame:
    """All pairs of rows of two dimension tables (regions, days): an equi-join on slices of the right one, so
    neither a list nor the pairs pass through the driver."""
    a = left.withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    b = right.withColumn("_z", F.pmod(F.xxhash64(*right.columns), F.lit(slices)).cast("int"))
    return a.join(b, "_z").drop("_z")


def region_pairs(regions: DataFrame, col: str = "region") -> DataFrame:
    """All ordered pairs of regions: the matrix index of C1-C3 (regions squared is the result's size)."""
    return pair_up(regions.select(F.col(col).alias("region_a")), regions.select(F.col(col).alias("region_b")))


# ---- C1 -----------------------------------------------------------------------

def co_occurrence(df: DataFrame, window_hours: float = 2.0, lower_triangle: bool = False) -> DataFrame:
    """C1 (+C7): ``value(a, b) = (P(b near a) + P(a near b)) / 2``; diagonal NULL.

    ``P(b near a)`` = share of a-starts with at least one b-start in ``[t - w, t + w]``.
    A b-start is within ±w of t (cell c) iff b has a start in c, or
    ``max_b(c - 1) >= t - w``, or ``min_b(c + 1) <= t + w``.
    """
    w_us = int(round(window_hours * 3600 * 1_000_000))
    s = _starts(df).withColumn("_cell", F.floor(F.col("_us") / F.lit(w_us)).cast("long"))
    cells = _cell_stats(s, w_us)
    # each b-cell informs three target cells: c-1 (via its min), c (presence), c+1 (via its max)
    near = (
        cells.select(F.col("region").alias("b"), (F.col("_cell") - 1).alias("_cell"), F.col("_min").alias("_nmin"),
                     F.lit(None).cast("long").alias("_pmax"), F.lit(False).alias("_same"))
        .unionByName(cells.select(F.col("region").alias("b"), "_cell", F.lit(None).cast("long").alias("_nmin"),
                                  F.lit(None).cast("long").alias("_pmax"), F.lit(True).alias("_same")))
        .unionByName(cells.select(F.col("region").alias("b"), (F.col("_cell") + 1).alias("_cell"),
                                  F.lit(None).cast("long").alias("_nmin"), F.col("_max").alias("_pmax"),
                                  F.lit(False).alias("_same")))
        .groupBy("_cell", "b")
        .agg(F.min("_nmin").alias("_nmin"), F.max("_pmax").alias("_pmax"), F.max("_same").alias("_same"))
    )
    hit = F.col("_same") | (F.col("_pmax") >= F.col("_us") - w_us) | (F.col("_nmin") <= F.col("_us") + w_us)
    # starts are counted per (region, instant) first; a busy cell is spread over SALTS copies
    at = s.groupBy("region", "_cell", "_us").agg(F.count(F.lit(1)).alias("_c"))
    at = at.withColumn("_salt", F.pmod(F.xxhash64("region", "_us"), F.lit(SALTS)).cast("int"))
    near = near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = (
        at.join(near, ["_cell", "_salt"])
        .filter((F.col("b") != F.col("region")) & hit)
        .groupBy(F.col("region").alias("a"), "b")
        .agg(F.sum("_c").alias("_h"))
    )
    n = s.groupBy("region").agg(F.count(F.lit(1)).alias("_n"))
    pairs = region_pairs(n.select("region"))
    m = (
        pairs.join(hits, (pairs.region_a == hits.a) & (pairs.region_b == hits.b), "left")
        .join(n.withColumnRenamed("region", "region_a"), "region_a")
        .select("region_a", "region_b", (F.coalesce(F.col("_h"), F.lit(0)) / F.col("_n")).alias("_m"))
    )
    # both directions of a pair meet in one group: no second evaluation of the matrix
    lo, hi = F.least("region_a", "region_b"), F.greatest("region_a", "region_b")
    both = m.groupBy(lo.alias("_lo"), hi.alias("_hi")).agg(F.sum("_m").alias("_sum"))
    value = F.when(F.col("_lo") == F.col("_hi"), F.lit(None).cast("double")).otherwise(F.col("_sum") / 2.0).alias("value")
    there = F.struct(F.col("_lo").alias("region_a"), F.col("_hi").alias("region_b"))
    back = F.struct(F.col("_hi").alias("region_a"), F.col("_lo").alias("region_b"))
    out = both.select(value, F.explode(F.when(F.col("_lo") == F.col("_hi"), F.array(there)).otherwise(F.array(there, back))).alias("_p"))
    out = out.select("_p.region_a", "_p.region_b", "value")
    if lower_triangle:
        out = out.filter(F.col("region_a") > F.col("region_b"))
    return out


# ---- C2 -----------------------------------------------------------------------

def _pearson(n, sx, sy, sxx, syy, sxy) -> F.Column:
    num = n * sxy - sx * sy
    den = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return F.when(den > 0, num / den)


def lag_correlation(df: DataFrame, max_lag_hours: int = 6, freq_seconds: int = 3600,
                    region_a: str | None = None, region_b: str | None = None) -> DataFrame:
    """Pearson of ``a[t]`` with ``b[t - lag]`` on the hourly 0/1 series, lag in [-L, L], 4 dp.

    Sign as in the original implementation: a negative lag means b follows a.
    All ordered pairs, or one pair when both regions are given.  Computed from
    sparse active cells: ``n = N - |lag|``, the co-active count from overlapping
    active runs (``_co_active_runs``), the single-series sums by counting active
    cells inside the overlapping index range.  Sums are exact integers; NULL when a series is
    constant over the overlap.
    """
    bounds = series_bounds(df, freq_seconds)  # once: one aggregate row
    lo, hi = bounds or (0, -1)
    one_pair = region_a is not None and region_b is not None
    d = df.filter(F.col("region").isin(region_a, region_b)) if one_pair else df
    act = active_cells(d, freq_seconds, hi).withColumnRenamed("b", "i")
    lags = F.sequence(F.lit(-max_lag_hours), F.lit(max_lag_hours))
    regs = d.filter(F.col("region").isNotNull() & F.col("started_at").isNotNull()).select("region").distinct()
    if one_pair:
        pairs = df.sparkSession.createDataFrame([(region_a, region_b)], "region_a string, region_b string")
        pairs = pairs.join(regs.withColumnRenamed("region", "region_a"), "region_a").join(
            regs.withColumnRenamed("region", "region_b"), "region_b")
    else:
        pairs = region_pairs(regs).filter(F.col("region_a") != F.col("region_b"))
    # per region and lag: active cells inside the a-role range and the b-role range
    role = act.select("region", "i", F.explode(lags).alias("lag"))
    in_a = (F.col("i") >= F.greatest(F.lit(0), F.col("lag")) + lo) & (F.col("i") <= F.least(F.lit(0), F.col("lag")) + hi)
    in_b = (F.col("i") >= F.lit(lo) - F.least(F.lit(0), F.col("lag"))) & (
        F.col("i") <= F.lit(hi) - F.greatest(F.lit(0), F.col("lag")))
    sums = role.groupBy("region", "lag").agg(F.count_if(in_a).alias("_sa"), F.count_if(in_b).alias("_sb"))
    co = _co_active_runs(act, max_lag_hours)
    grid = pairs.select("region_a", "region_b", F.explode(lags).alias("lag"))
    sa = sums.select(F.col("region").alias("region_a"), "lag", "_sa")
    sb = sums.select(F.col("region").alias("region_b"), "lag", "_sb")
    g = (
        grid
        .join(sa, ["region_a", "lag"], "left")
        .join(sb, ["region_b", "lag"], "left")
        .join(co, ["region_a", "region_b", "lag"], "left")
    )
    n = (F.lit(hi - lo + 1) - F.abs(F.col("lag"))).cast("double")
    sx = F.coalesce(F.col("_sa"), F.lit(0)).cast("double")
    sy = F.coalesce(F.col("_sb"), F.lit(0)).cast("double")
    sxy = F.coalesce(F.col("_sxy"), F.lit(0)).cast("double")
    return g.select(
        "region_a", "region_b", F.col("lag").alias("lag_hours"),
        F.bround(_pearson(n, sx, sy, sx, sy, sxy), 4).alias("correlation"),
    )


def _co_active_runs(act: DataFrame, max_lag: int, bin_buckets: int = 24) -> DataFrame:
    """Co-active counts ``#{i : a active at i, b active at i - lag}`` per (a, b, lag) from runs.

    Active cells are collapsed into runs (gaps and islands over a region's active
    cells, at most span / freq rows per region).  Run pairs of two regions that come
    within ``max_lag`` of each other are found by an equi-join on coarse bins (each
    pair kept once, in its first common bin), and each lag's overlap is arithmetic:
    ``min(a2, b2 + lag) - max(a1, b1 + lag) + 1``.  Work grows with runs, not with
    active cells x regions x lags.
    """
    w = Window.partitionBy("region").orderBy("i")
    runs = (
        act.withColumn("_g", F.col("i") - F.row_number().over(w))
        .groupBy("region", "_g").agg(F.min("i").alias("r1"), F.max("i").alias("r2"))
    )
    L = int(max_lag)
    a = runs.select(
        F.col("region").alias("region_a"), F.col("r1").alias("a1"), F.col("r2").alias("a2"),
        F.explode(F.sequence(F.floor((F.col("r1") - L) / bin_buckets).cast("long"),
                             F.floor((F.col("r2") + L) / bin_buckets).cast("long"))).alias("_bin"),
    )
    b = runs.select(
        F.col("region").alias("region_b"), F.col("r1").alias("b1"), F.col("r2").alias("b2"),
        F.explode(F.sequence(F.floor(F.col("r1") / bin_buckets).cast("long"),
                             F.floor(F.col("r2") / bin_buckets).cast("long"))).alias("_bin"),
    )
    first_common = F.greatest(F.floor((F.col("a1") - L) / bin_buckets), F.floor(F.col("b1") / bin_buckets)).cast("long")
    pairs = a.join(b, "_bin").filter(
        (F.col("b1") <= F.col("a2") + L) & (F.col("b2") >= F.col("a1") - L) & (F.col("_bin") == first_common)
    )
    lagged = pairs.select("region_a", "region_b", "a1", "a2", "b1", "b2",
                          F.explode(F.sequence(F.lit(-L), F.lit(L))).alias("lag"))
    overlap = F.least(F.col("a2"), F.col("b2") + F.col("lag")) - F.greatest(F.col("a1"), F.col("b1") + F.col("lag")) + 1
    return (
        lagged.filter(overlap > 0)
        .groupBy("region_a", "region_b", "lag")
        .agg(F.sum(overlap).alias("_sxy"))
    )


# ---- C3 -----------------------------------------------------------------------

def _daily_grid(df: DataFrame) -> DataFrame:
    """(date, region, n): dates with at least one start anywhere x regions present, zero-filled."""
    d = df.filter(F.col("region").isNotNull())
    counts = d.groupBy("date", "region").agg(F.count(F.lit(1)).alias("n"))
    grid = pair_up(d.select("region").distinct(), d.select("date").distinct())
    return grid.join(counts, ["date", "region"], "left").select(
        "date", "region", F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("x")
    )


def rank_correlation(df: DataFrame, method: str = "spearman") -> DataFrame:
    """Region x region correlation of daily start counts, 3 dp; NULL without variance.

    ``spearman``: Pearson on average ranks; ``pearson``: on the counts; ``kendall``: tau-b, where the
    diagonal is 1 even without variance (the convention of the original's library).
    """
    g = _daily_grid(df)
    if method == "kendall":
        return _kendall(g)
    if method == "spearman":
        w = Window.partitionBy("region").orderBy("x")
        ties = Window.partitionBy("region", "x")
        g = g.withColumn("x", F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)
    elif method != "pearson":
        raise ValueError("method must be spearman, pearson or kendall")
    a = g.select("date", F.col("region").alias("region_a"), F.col("x").alias("xa"))
    b = g.select("date", F.col("region").alias("region_b"), F.col("x").alias("xb"))
    s = a.join(b, "date").groupBy("region_a", "region_b").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("xa").alias("sx"), F.sum("xb").alias("sy"),
        F.sum(F.col("xa") * F.col("xa")).alias("sxx"), F.sum(F.col("xb") * F.col("xb")).alias("syy"),
        F.sum(F.col("xa") * F.col("xb")).alias("sxy"),
    )
    r = _pearson(F.col("n"), F.col("sx"), F.col("sy"), F.col("sxx"), F.col("syy"), F.col("sxy"))
    return s.select("region_a", "region_b", F.bround(r, 3).alias("value"))


def _kendall(g: DataFrame) -> DataFrame:
    """tau-b by counting inversions over dyadic rank blocks.

    Days are counted per pair of ranks (ra, rb) of two regions a < b.  Two different ranks ra part at exactly
    one bit: at that level they lie in the lower and the upper half of one block of ranks.  So per level the
    days of a block's lower half are counted, in order of rb, by a prefix sum, and every entry of the upper half
    reads off how many of them have a smaller and a larger rb: concordant minus discordant day pairs.
    A cell is read once per level (log2 of a region's distinct values); cells and days are never paired.
    """
    w = Window.partitionBy("region")
    g = g.withColumn("_r", F.dense_rank().over(w.orderBy("x")) - 1).withColumn("_m", F.max("_r").over(w))
    own = g.groupBy("region", "x").agg(F.count(F.lit(1)).alias("c")).groupBy("region").agg(
        ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2.0).alias("untied"))
    a = g.select("date", F.col("region").alias("region_a"), F.col("_r").alias("ra"), F.col("_m").alias("_m"))
    b = g.select("date", F.col("region").alias("region_b"), F.col("_r").alias("rb"))
    cells = a.join(b, "date").filter((F.col("region_a") < F.col("region_b")) & (F.col("_m") > 0)).groupBy(
        "region_a", "region_b", "_m", "ra", "rb").agg(F.count(F.lit(1)).alias("c"))
    levels = F.explode(F.sequence(F.lit(0), F.length(F.bin("_m")) - 1))
    split = cells.select("region_a", "region_b", "ra", "rb", "c", levels.alias("_l"))
    block, upper_half = F.expr("shiftright(ra, _l + 1)"), F.expr("shiftright(ra, _l) % 2 = 1")
    halves = split.groupBy("region_a", "region_b", "_l", block.alias("_block"), "rb").agg(
        F.sum(F.when(~upper_half, F.col("c")).otherwise(0)).alias("c0"), F.sum(F.when(upper_half, F.col("c")).otherwise(0)).alias("c1"))
    in_block = Window.partitionBy("region_a", "region_b", "_l", "_block")
    below = F.sum("c0").over(in_block.orderBy("rb").rowsBetween(_UNB, 0)) - F.col("c0")
    above = F.sum("c0").over(in_block) - below - F.col("c0")
    s = halves.select("region_a", "region_b", (F.col("c1") * (below - above)).alias("_d")).groupBy("region_a", "region_b").agg(
        F.sum("_d").alias("_s"))
    regs = own.select("region")
    upper = region_pairs(regs).filter(F.col("region_a") < F.col("region_b")).join(s, ["region_a", "region_b"], "left")
    upper = upper.join(own.select(F.col("region").alias("region_a"), F.col("untied").alias("_na")), "region_a").join(
        own.select(F.col("region").alias("region_b"), F.col("untied").alias("_nb")), "region_b")
    den = F.sqrt(F.col("_na") * F.col("_nb"))
    value = F.bround(F.when(den > 0, F.coalesce("_s", F.lit(0)) / den), 3) + F.lit(0.0)
    upper = upper.select("region_a", "region_b", value.alias("value"))
    both = upper.select(F.explode(F.array(
        F.struct("region_a", "region_b", "value"),
        F.struct(F.col("region_b").alias("region_a"), F.col("region_a").alias("region_b"), "value"))).alias("_p")).select("_p.*")
    return both.unionByName(regs.select(F.col("region").alias("region_a"), F.col("region").alias("region_b"), F.lit(1.0).alias("value")))


# ---- C4 -----------------------------------------------------------------------

CHUNK_WINDOWS = 2  # width of a chunk of the wave chain, in windows


def _distinct_starts(df: DataFrame) -> DataFrame:
    return _starts(df).groupBy("region", "_us").agg(F.first("started_at").alias("started_at"))


def wave_candidates(df: DataFrame, min_regions: int = 5, window_hours: float = 3.0) -> DataFrame:
    """Distinct start times T whose forward window [T, T + w] holds >= min_regions regions.

    A region with a start s is met from every T in [s - w, s]; of its starts in order, those at
    most w apart make one such interval.  So a region's intervals begin and end at its gaps, and a running
    sum over begins and ends, read at the start times, counts the regions: a few rows per gap, no
    start x region rows.  Both scans run per chunk of time with a carry.
    """
    w_us = int(round(window_hours * 3600 * 1_000_000))
    chunk = F.lit(max(w_us * 8, 86_400_000_000))
    s = _starts(df).select("region", "_us").distinct().withColumn("_b", F.floor(F.col("_us") / chunk).cast("long"))
    following = next_in_order(s, ["region"], "_b", "_us", ["_us"])
    nxt = F.col("_next__us")
    gaps = following.filter(nxt.isNull() | (nxt - F.col("_us") > w_us))
    edges = gaps.select(F.explode(F.array(
        F.struct((F.col("_us") + 1).alias("_x"), F.lit(-1).alias("_d")), F.struct((nxt - w_us).alias("_x"), F.lit(1).alias("_d")))).alias("_e"))
    firsts = s.groupBy("region").agg(F.min("_us").alias("_us")).select((F.col("_us") - w_us).alias("_x"), F.lit(1).alias("_d"))
    events = edges.select("_e._x", "_e._d").filter(F.col("_x").isNotNull()).unionByName(firsts).withColumn("_at", F.lit(0))
    probes = s.select(F.col("_us").alias("_x"), F.lit(0).alias("_d"), F.lit(1).alias("_at"))
    line = events.unionByName(probes).groupBy("_x").agg(F.sum("_d").alias("_d"), F.max("_at").alias("_at"))
    line = line.withColumn("_b", F.floor(F.col("_x") / chunk).cast("long"))
    counted = running(line, [], "_b", [F.asc("_x")], [("_n", "_d", "sum")])
    return counted.filter((F.col("_at") == 1) & (F.col("_n") >= min_regions)).select(F.col("_x").alias("_t"))


def _follow(t: np.ndarray, w_us: int) -> np.ndarray:
    """Index of the first time after each time's window, len(t) where there is none."""
    return np.searchsorted(t, t + w_us, side="right")


def _transitions(w_us: int, chunk_us: int):
    """Per chunk: where the chain leaves it, as a step function of the earliest time still allowed on entry.

    A chain that enters at or before ``upto`` (and after the previous row's) next allows ``leave``; one that enters
    after the last ``upto`` finds no candidate and passes through.  Entries lie in the first window only."""

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["_t"].to_numpy())
        chunk = int(pdf["_c"].iloc[0])
        nxt, last = _follow(t, w_us), np.arange(len(t))
        while (on := nxt[last] < len(t)).any():  # at most chunk / window + 1 rounds
            last[on] = nxt[last[on]]
        reached = np.concatenate(([True], t[:-1] < chunk * chunk_us + w_us))
        upto, leave = t[reached], t[last[reached]] + w_us + 1
        keep = np.concatenate((leave[1:] != leave[:-1], [True]))
        return pd.DataFrame({"_c": chunk, "_upto": upto[keep], "_leave": leave[keep]})

    return steps


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry state of every chunk, from the steps of all chunks in order."""
    pdf = pdf.sort_values(["_c", "_upto"])
    chunks, first = np.unique(pdf["_c"].to_numpy(), return_index=True)
    upto, leave = pdf["_upto"].to_numpy(), pdf["_leave"].to_numpy()
    enter, state = np.empty(len(chunks), dtype=np.int64), np.iinfo(np.int64).min
    for k, (a, b) in enumerate(zip(first, [*first[1:], len(upto)], strict=True)):
        enter[k] = state
        at = a + int(np.searchsorted(upto[a:b], state))
        state = leave[at] if at < b else state
    return pd.DataFrame({"_c": chunks, "_enter": enter})


def _picks(w_us: int):
    def chosen(cands: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(cands["_t"].to_numpy())
        nxt, out = _follow(t, w_us), []
        at = int(np.searchsorted(t, entry["_enter"].iloc[0])) if len(t) else 0
        while at < len(t):
            out.append(t[at])
            at = int(nxt[at])
        return pd.DataFrame({"_t": np.array(out, dtype=np.int64)})

    return chosen


def greedy_chain(cands: DataFrame, w_us: int, chunk_us: int | None = None) -> DataFrame:
    """Selected wave starts: first candidate, then repeatedly the first candidate > last + w.

    The choice inside a chunk of time depends on what came before only through the earliest time still
    allowed, which lies in the chunk's first window.  So each chunk is reduced to its transitions (entry
    state -> exit state; chains merge, so they are few), these are composed once over the list of
    chunks, and each chunk picks its waves from its own entry state.  A fixed number of jobs, whatever
    the length of the chain.  A chunk's group holds the distinct candidate instants of two windows
    (3,600 an hour at second resolution, however many rows start then); the composition
    reads the transitions of the span's chunks, not rows of the data.
    """
    chunk_us = chunk_us or CHUNK_WINDOWS * w_us
    cands = write_table(cands.select("_t", F.floor(F.col("_t") / F.lit(chunk_us)).cast("long").alias("_c")), "wave-candidates")
    steps = cands.groupBy("_c").applyInPandas(_transitions(w_us, chunk_us), "_c long, _upto long, _leave long")
    entries = steps.groupBy().applyInPandas(_compose, "_c long, _enter long")
    return cands.groupBy("_c").cogroup(entries.groupBy("_c")).applyInPandas(_picks(w_us), "_t long")


def waves(df: DataFrame, min_regions: int = 5, window_hours: float = 3.0, tz: str = "Europe/Kyiv") -> DataFrame:
    """C4: non-overlapping bursts of >= min_regions regions within ``window_hours``.

    Output: rank (1 = most regions; ties in time order), wave_start, date (local, text),
    first_region, regions_hit, duration_h (2 dp), sequence = array<struct<region, started_at>> of
    each region's first start in the window, ordered by (started_at, region).  The rank is a window
    over the wave table; waves lie more than the window apart, so it is bounded by the span.
    """
    w_us = int(round(window_hours * 3600 * 1_000_000))
    s = _distinct_starts(df).withColumn("_cell", F.floor(F.col("_us") / F.lit(w_us)).cast("long"))
    sel = greedy_chain(wave_candidates(df, min_regions, window_hours), w_us)
    sel = sel.select("_t", F.explode(F.array(
        F.floor(F.col("_t") / F.lit(w_us)).cast("long"), F.floor(F.col("_t") / F.lit(w_us)).cast("long") + 1
    )).alias("_cell"))
    members = (
        s.join(sel, "_cell")
        .filter((F.col("_us") >= F.col("_t")) & (F.col("_us") <= F.col("_t") + w_us))
        .groupBy("_t", "region").agg(F.min("started_at").alias("started_at"))
    )
    agg = members.groupBy("_t").agg(
        F.sort_array(F.collect_list(F.struct("started_at", "region"))).alias("_seq"),  # <= number of regions
    )
    first = F.col("_seq")[0]
    last = F.element_at(F.col("_seq"), -1)
    out = agg.select(
        first["started_at"].alias("wave_start"),
        F.date_format(tc.to_local(first["started_at"], tz), "yyyy-MM-dd").alias("date"),
        first["region"].alias("first_region"),
        F.size("_seq").alias("regions_hit"),
        F.bround(tc.micros_between(first["started_at"], last["started_at"]) / F.lit(3_600_000_000.0), 2).alias(
            "duration_h"),
        F.transform("_seq", lambda x: F.struct(x["region"].alias("region"), x["started_at"].alias("started_at"))).alias(
            "sequence"),
    )
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("regions_hit"), "wave_start")))


def wave_sequence(wv: DataFrame) -> DataFrame:
    """Flat form of the wave sequences: wave_start, position, region, started_at."""
    return wv.select("wave_start", F.posexplode("sequence").alias("position", "item")).select(
        "wave_start", "position", F.col("item.region").alias("region"), F.col("item.started_at").alias("started_at")
    )


def wave_detail(wv: DataFrame, limit: int | None = None) -> DataFrame:
    """All waves by date (newest first), regions hit, then start, as ``list_position`` (from 1), with
    minutes from the first start (1 dp); ``limit`` keeps the first so many waves of the list."""
    order = Window.orderBy(F.desc("date"), F.desc("regions_hit"), "wave_start")  # one row per wave
    listed = wv.withColumn("list_position", F.row_number().over(order))
    if limit is not None:
        listed = listed.filter(F.col("list_position") <= limit)
    seq = listed.select("list_position", "wave_start", F.posexplode("sequence").alias("position", "item"))
    return seq.select(
        "list_position", "wave_start", "position", F.col("item.region").alias("region"), F.col("item.started_at").alias("started_at"),
        F.bround(tc.micros_between("wave_start", "item.started_at") / F.lit(60_000_000.0), 1).alias("minutes_from_first"),
    )


def wave_frames(wv: DataFrame, frame_minutes: int = 5) -> DataFrame:
    """Replay frames; region active from frame ``int(sec / 300)`` to the last frame (cumulative).

    ``n_frames = max(int(total_min / 5) + 2, 2)``.  Output: wave_start, frame, region.
    """
    seq = wave_sequence(wv).withColumn("_sec", tc.micros_between("wave_start", "started_at") / F.lit(1_000_000.0))
    tot = seq.groupBy("wave_start").agg(F.max("_sec").alias("_tot"))
    frame_sec = frame_minutes * 60
    seq = seq.join(tot, "wave_start").withColumn(
        "_nf", F.greatest(F.floor(F.col("_tot") / 60.0 / frame_minutes).cast("int") + 2, F.lit(2))
    ).withColumn("_f0", F.floor(F.col("_sec") / frame_sec).cast("int"))
    return seq.filter(F.col("_f0") <= F.col("_nf") - 1).select(
        "wave_start", F.explode(F.sequence(F.col("_f0"), F.col("_nf") - 1)).alias("frame"), "region"
    )
