"""Kaplan-Meier survival of episode durations (K1-K6).

The estimator runs on the table of distinct durations per label (``groupBy``
with map-side combine), never on raw rows: its size is bounded by the number of
distinct durations, which the duration cap and the time resolution bound.

Columns: label, timeline, survival, ci_lower, ci_upper.

* ``S(t) = prod(1 - d_i / n_i)`` over event times ``t_i <= t``; at-risk ``n_i`` counts
  durations ``>= t_i`` (a row censored at ``t_i`` is still at risk), the curve starts at
  ``t = 0`` with ``S = 1``.
* When a label has no censored rows the product telescopes to the exact ratio
  ``(N - events so far) / N``; otherwise it is ``exp(sum(ln(1 - d/n)))`` with a
  guard that sets S to 0 once some ``d = n`` (``ln(0)`` is NULL and would be skipped).
* 95 % band: exponential (log-log) Greenwood, ``V = sum d / (n (n - d))``,
  ``exp(-exp(ln(-ln S) ± z sqrt(V) / ln S))``; rows where the band is undefined
  (``S = 1`` or ``S = 0``) get 1.0, the fill rule of the estimator the original uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.scans import next_in_order, running
from spanwise.operators.temporal import with_scalars

Z95 = 1.959963984540054  # standard normal quantile at 0.975
CAP_MINUTES = 600.0
CUTOFF = 0.05
BUCKET_MINUTES = 1.0  # width of the scan buckets of the two-level running sums


def _curve(rows: DataFrame, ci_digits: int = 10) -> DataFrame:
    """rows: (label, t double, event int) -> KM curve per label."""
    per_t = rows.groupBy("label", "t").agg(
        F.count(F.lit(1)).alias("_m"), F.sum("event").alias("_d")
    )
    # make sure t = 0 exists (with no removals when no duration is 0)
    origin = rows.select("label").distinct().select("label", F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("_m"),
                                                    F.lit(0).cast("long").alias("_d"))
    per_t = per_t.unionByName(origin).groupBy("label", "t").agg(F.sum("_m").alias("_m"), F.sum("_d").alias("_d"))
    # running sums in two levels (local window per (label, minute bucket) + bucket offsets),
    # so even one label's curve is spread over many tasks
    per_t = per_t.withColumn("_b", F.floor(F.col("t") / BUCKET_MINUTES).cast("long"))
    k = running(per_t, ["label"], "_b", [F.desc("t")], [("_n", "_m", "sum")], descending=True)
    # label totals (one row per label) joined back
    tot = per_t.groupBy("label").agg(F.sum("_m").alias("_total"), F.sum(F.col("_m") - F.col("_d")).alias("_cens"))
    k = k.join(tot, "label")
    log_term = F.log(1.0 - F.col("_d") / F.col("_n"))
    green = F.when(F.col("_n") > F.col("_d"), F.col("_d") / (F.col("_n") * (F.col("_n") - F.col("_d"))))
    k = k.select(
        "*",
        (F.col("_d") == F.col("_n")).cast("int").alias("_full"),
        F.when(F.col("_d") < F.col("_n"), log_term).otherwise(F.lit(0.0)).alias("_lt"),
        F.coalesce(green, F.lit(0.0)).alias("_gt"),
    )
    k = running(k, ["label"], "_b", [F.asc("t")],
                [("_dcum", "_d", "sum"), ("_all", "_full", "max"), ("_lsum", "_lt", "sum"), ("_V", "_gt", "sum")])
    s_exact = (F.col("_total") - F.col("_dcum")) / F.col("_total")
    s_prod = F.when(F.col("_all") == 1, F.lit(0.0)).otherwise(F.exp("_lsum"))
    k = k.withColumn("survival", F.when(F.col("_cens") == 0, s_exact).otherwise(s_prod))
    v = F.log(F.col("survival"))
    defined = (F.col("survival") > 0) & (F.col("survival") < 1) & (F.col("_all") == 0)
    upper = F.exp(-F.exp(F.log(-v) + F.lit(Z95) * F.sqrt("_V") / v))
    lower = F.exp(-F.exp(F.log(-v) - F.lit(Z95) * F.sqrt("_V") / v))
    return k.select(
        "label",
        F.col("t").alias("timeline"),
        "survival",
        F.when(defined, F.bround(lower, ci_digits)).otherwise(F.lit(1.0)).alias("ci_lower"),
        F.when(defined, F.bround(upper, ci_digits)).otherwise(F.lit(1.0)).alias("ci_upper"),
    )


def _with_as_of(df: DataFrame, as_of) -> DataFrame:
    """Optional: an open episode is censored at ``as_of - start`` instead of having no duration.

    Off by default (the original drops open episodes, so no censored row reaches the estimator)."""
    if as_of is None:
        return df
    from spanwise.functions import timecols as tc
    open_dur = tc.minutes_between("started_at", F.lit(str(as_of)).cast("timestamp_ntz"))
    return df.withColumn("duration_min", F.coalesce(F.col("duration_min"), open_dur)).withColumn(
        "censored", F.col("finished_at").isNull())


def _rows(df: DataFrame, label_col=None) -> DataFrame:
    d = df.filter(F.col("duration_min").isNotNull() & (F.col("duration_min") >= 0))
    label = F.lit("all") if label_col is None else F.col(label_col).cast("string")
    return d.select(
        label.alias("label"),
        F.col("duration_min").cast("double").alias("t"),
        (~F.coalesce(F.col("censored"), F.lit(False))).cast("int").alias("event"),
    )


def kaplan_meier(df: DataFrame, label: str = "all", as_of=None, timeline=None) -> DataFrame:
    """K1: one curve for all rows with a duration >= 0 (``as_of``: see ``_with_as_of``).

    ``timeline``: evaluate the curve at these times instead of at the observed durations; each
    time takes the last point at or before it (1.0 before the first)."""
    d = _with_as_of(df, as_of).filter(F.col("duration_min").isNotNull() & (F.col("duration_min") >= 0))
    curve = _curve(d.select(
        F.lit(label).alias("label"), F.col("duration_min").cast("double").alias("t"),
        (~F.coalesce(F.col("censored"), F.lit(False))).cast("int").alias("event"),
    ))
    return curve if timeline is None else at_times(curve, timeline)


def at_times(km: DataFrame, times) -> DataFrame:
    """Curves (any labels) read off at the given times, as step functions."""
    labels = km.select("label").distinct()
    wanted = labels.select("label", F.explode(F.array(*[F.lit(float(t)) for t in sorted(set(times))])).alias("timeline"))
    cols = ["survival", "ci_lower", "ci_upper"]
    points = km.select("label", "timeline", F.lit(0).alias("_probe"), F.struct("timeline", *cols).alias("_p"))
    probes = wanted.select("label", "timeline", F.lit(1).alias("_probe"), F.lit(None).cast(points.schema["_p"].dataType).alias("_p"))
    u = points.unionByName(probes).withColumn("_b", F.floor(F.col("timeline") / BUCKET_MINUTES).cast("long"))
    # structs compare by their first field, so the running max is the last point seen
    u = running(u, ["label"], "_b", [F.asc("timeline"), F.asc("_probe")], [("_last", "_p", "max")])
    return u.filter(F.col("_probe") == 1).select(
        "label", "timeline", *[F.coalesce(F.col(f"_last.{c}"), F.lit(1.0)).alias(c) for c in cols])


def strata_counts(df: DataFrame, strata_col: str = "hour", groups=None, min_observations: int = 10, as_of=None) -> DataFrame:
    """K2: which strata get a curve: (position, label, n, kept).

    ``position`` is the place in ``groups``, or in the sorted values when there are none; groups
    without rows are listed with n = 0.  The table has one row per stratum."""
    base = _with_as_of(df, as_of).filter(F.col(strata_col).isNotNull())
    n = base.groupBy(F.col(strata_col).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    if groups is not None:
        kind = df.schema[strata_col].dataType
        wanted = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(g).cast(kind) for g in groups])).alias("position", "_g"))
        n = wanted.join(n, F.col("_g") == F.col("_v"), "left").select("position", F.col("_g").alias("_v"), F.coalesce("n", F.lit(0)).alias("n"))
    else:
        n = n.withColumn("position", F.row_number().over(Window.orderBy("_v")) - 1)
    return n.select("position", F.col("_v").cast("string").alias("label"), "n", (F.col("n") >= min_observations).alias("kept"))


def kaplan_meier_stratified(df: DataFrame, strata_col: str = "hour", groups=None, min_observations: int = 10,
                            as_of=None, labels: dict | None = None) -> DataFrame:
    """K2: one curve per stratum value in one pass, with the stratum's ``position``; strata with
    < min rows (counted before the duration filter) have no curve (``strata_counts`` lists them);
    label = the value as text, or its entry in ``labels``."""
    base = _with_as_of(df, as_of).filter(F.col(strata_col).isNotNull())
    if groups is not None:
        base = base.filter(F.col(strata_col).isin(list(groups)))
    strata = strata_counts(df, strata_col, groups, min_observations, as_of).filter("kept").select("position", "label")
    curves = _curve(_rows(base, strata_col)).join(strata, "label")
    if labels:
        named = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        curves = curves.withColumn("label", F.coalesce(F.try_element_at(named, F.col("label")), F.col("label")))
    return curves


def hazard(km: DataFrame) -> DataFrame:
    """K3 at every curve point: ``(S - S') / (dt * S)`` with the next point; NULL on the last
    point, when dt <= 0, S <= 0 or S' > S.  The next point comes from a two-level lookup
    (lead inside a time bucket, first point of the next bucket across buckets)."""
    k = km.withColumn("_b", F.floor(F.col("timeline") / BUCKET_MINUTES).cast("long"))
    k = next_in_order(k, ["label"], "_b", "timeline", ["survival", "timeline"])
    sn, tn = F.col("_next_survival"), F.col("_next_timeline")
    dt = tn - F.col("timeline")
    h = -(sn - F.col("survival")) / (dt * F.col("survival"))
    ok = sn.isNotNull() & (dt > 0) & (F.col("survival") > 0) & (sn <= F.col("survival"))
    return k.select("label", "timeline", F.when(ok, h).alias("hazard"))


def hazard_at(km: DataFrame, t_minutes: float) -> DataFrame:
    """K3 at one elapsed time: uses the last point with timeline <= t (floor lookup)."""
    hz = hazard(km)
    floor_t = hz.filter(F.col("timeline") <= t_minutes).groupBy("label").agg(F.max("timeline").alias("timeline"))
    return hz.join(floor_t, ["label", "timeline"]).select("label", F.lit(float(t_minutes)).alias("t"), "hazard")


def median_remaining(km: DataFrame) -> DataFrame:
    """K4 at every curve point (elapsed = timeline): first later point with
    ``S <= S(elapsed) / 2`` minus elapsed; NULL when the curve never gets there.

    Curves are non-increasing, so the answer is the smallest timeline among points
    with ``S <= target`` (target = S(elapsed) / 2): a running minimum over the union
    of targets and points, scanned by value in two levels (value buckets).
    """
    pts = km.select("label", F.col("survival").alias("_v"), F.lit(1).alias("_kind"), F.col("timeline").alias("_t"),
                    F.lit(None).cast("double").alias("_el"))
    qs = km.select("label", (F.col("survival") / 2.0).alias("_v"), F.lit(0).alias("_kind"),
                   F.lit(None).cast("double").alias("_t"), F.col("timeline").alias("_el"))
    # scanning by value ascending (points before targets at equal value), the running min of
    # point timelines up to a target is the min over points with S <= target (two-level scan)
    u = pts.unionByName(qs).withColumn("_b", F.floor(F.col("_v") * 1024).cast("long"))
    u = running(u, ["label"], "_b", [F.asc("_v"), F.desc("_kind")], [("_first", "_t", "min")])
    u = u.filter(F.col("_kind") == 0)
    return u.select("label", F.col("_el").alias("elapsed"), (F.col("_first") - F.col("_el")).alias("median_remaining"))


def median_remaining_at(km: DataFrame, elapsed: float) -> DataFrame:
    """K4 at one elapsed time, on the curve or between its points: S is read at the first point at or
    after ``elapsed``; NULL when there is none or the curve never falls to half of it."""
    later = km.filter(F.col("timeline") >= float(elapsed))
    start = later.groupBy("label").agg(F.min_by("survival", "timeline").alias("_s"))
    crossed = later.join(start, "label").groupBy("label").agg(
        F.min(F.when(F.col("survival") <= F.col("_s") * 0.5, F.col("timeline"))).alias("_t"))
    return km.select("label").distinct().join(crossed, "label", "left").select(
        "label", F.lit(float(elapsed)).alias("elapsed"), (F.col("_t") - float(elapsed)).alias("median_remaining"))


def km_median(km: DataFrame, cap: float = CAP_MINUTES) -> DataFrame:
    """K5: first timeline with S <= 0.5 per label, else ``cap`` with ``capped = true``."""
    m = km.groupBy("label").agg(F.min(F.when(F.col("survival") <= 0.5, F.col("timeline"))).alias("_m"))
    return m.select(
        "label",
        F.coalesce(F.col("_m"), F.lit(float(cap))).alias("median_min"),
        F.col("_m").isNull().alias("capped"),
    )


def km_truncated(km: DataFrame, cutoff: float = CUTOFF, x_cap: float = CAP_MINUTES) -> DataFrame:
    """K6: every point with ``shown``: true up to and including the label's first point with
    S < cutoff; ``x_max = min(cap, max timeline)``."""
    first_below = km.groupBy("label").agg(F.min(F.when(F.col("survival") < cutoff, F.col("timeline"))).alias("_fb"))
    shown = F.col("_fb").isNull() | (F.col("timeline") <= F.col("_fb"))
    kept = km.join(first_below, "label").withColumn("shown", shown).drop("_fb")
    x_max = km.agg(F.least(F.lit(float(x_cap)), F.max("timeline")).alias("x_max"))
    return with_scalars(kept, x_max)
