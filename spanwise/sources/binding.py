"""Bind the driver's ``events`` table to the raw interval-record schema.

No alert data ships with the repository, so the analytics run on records that
Spark derives from ``events`` — every row, no sampling:

* region: ``'R' + lpad(user_id % n_regions, 2)``; ``click`` rows use the variant
  spelling ``'<region> область'`` so canonicalisation has work to do;
* level: ``error`` -> oblast, ``view`` -> hromada, other types -> raion;
* district / locality code: ``props.k % 8`` at the matching level;
* start: ``ts`` as ``YYYY-MM-DD HH:MM:SS+00:00``; rows with ``props.k = 0`` carry
  the unparseable text ``NOT_A_DATE``;
* finish: ``ts + round(value * 60)`` seconds; rows with ``props.k = 1`` are open;
* every record is emitted twice (``primary`` and ``mirror`` source), as in the
  published raw file, so the six-column dedup removes one copy.

``second_source_from_events`` emits one row per event (region, start, type) for
the two-source reconciliation.  The SQL texts below build the same tables in
DuckDB for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.config import Profile

N_REGIONS = 25
CAP_HOURS = 3  # the 12 h cap never fires on these durations (max ≈ 9 h)
EXCLUDED = ("R24",)
VARIANT_SUFFIX = " область"


def region_name(i: int) -> str:
    return f"R{i:02d}"


def binding_profile() -> Profile:
    names = [region_name(i) for i in range(N_REGIONS)]
    # centroids on a 5 x 5 grid, derived from the index
    regions = tuple((n, f"Region {n[1:]}", 45.0 + (i // 5), 22.0 + 3 * (i % 5)) for i, n in enumerate(names))
    aliases = {n + VARIANT_SUFFIX: n for n in names}
    return Profile(cap_hours=CAP_HOURS, regions=regions, aliases=aliases, excluded=EXCLUDED)


def _region_base(user_id) -> F.Column:
    return F.concat(F.lit("R"), F.lpad((user_id % F.lit(N_REGIONS)).cast("string"), 2, "0"))


def _fmt(ts) -> F.Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))


def raw_alerts_from_events(events: DataFrame) -> DataFrame:
    # k is read once per event (a JSON lookup is not cheap, so Catalyst keeps it in its own projection)
    events = events.select("ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("_k"))
    k = F.col("_k")
    base = _region_base(F.col("user_id"))
    level = (
        F.when(F.col("event_type") == "error", "oblast")
        .when(F.col("event_type") == "view", "hromada")
        .otherwise("raion")
    )
    code = (k % 8).cast("string")
    finish_ts = F.timestamp_add("SECOND", F.round(F.col("value") * 60).cast("long"), F.col("ts"))
    rows = events.select(
        F.when(F.col("event_type") == "click", F.concat(base, F.lit(VARIANT_SUFFIX))).otherwise(base).alias("oblast"),
        F.when(level == "raion", code).alias("raion"),
        F.when(level == "hromada", code).alias("hromada"),
        level.alias("level"),
        F.when(k == 0, F.lit("NOT_A_DATE")).otherwise(_fmt(F.col("ts"))).alias("started_at"),
        F.when(k == 1, F.lit(None).cast("string")).otherwise(_fmt(finish_ts)).alias("finished_at"),
    )
    copies = F.explode(F.array(F.lit("primary"), F.lit("mirror"))).alias("source")
    return rows.select("*", copies)


def second_source_from_events(events: DataFrame) -> DataFrame:
    base = _region_base(F.col("user_id"))
    return events.select(
        F.when(F.col("event_type") == "signup", F.concat(base, F.lit(VARIANT_SUFFIX))).otherwise(base).alias("region"),
        _fmt(F.col("ts")).alias("started_at"),
        F.col("event_type").alias("kind"),
    )


def intervals_from_orders(orders: DataFrame) -> DataFrame:
    """Second binding: one closed interval per order over seven years (region from the customer key,
    as many minutes as whole thousands of the price)."""
    end = F.timestamp_add("MINUTE", F.floor(F.col("o_totalprice") / 1000).cast("long"), F.col("o_orderdate"))
    return orders.select(_region_base(F.col("o_custkey")).alias("region"), F.col("o_orderdate").alias("started_at"), end.alias("finished_at"))


def features_from_nations(nations: DataFrame) -> DataFrame:
    """A FeatureCollection document (one text row) with a point per nation, for the feature ingest:
    region 1 is abroad; two names take the English override, the others the variant spelling."""
    key = F.col("n_nationkey").cast("int")
    name = F.when(key == 0, "Kiev").when(key == 5, "Kiev City").otherwise(F.col("n_name"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.when(F.col("n_regionkey") == 1, "Elsewhere").otherwise("Ukraine").alias("admin"), name.alias("name"),
                 F.concat(_region_base(key), F.lit(VARIANT_SUFFIX)).alias("name_uk")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(22.5 + key, 45.25 + key / 2.0).alias("coordinates")).alias("geometry"),
    )
    doc = F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))
    return nations.agg(F.to_json(doc).alias("value"))


# --- DuckDB text for the oracle -------------------------------------------------

def _sql_base(uid: str) -> str:
    return f"('R' || lpad(CAST({uid} % {N_REGIONS} AS VARCHAR), 2, '0'))"


def _sql_fmt(ts: str) -> str:
    return f"(strftime({ts}, '%Y-%m-%d %H:%M:%S') || '+00:00')"


_RAW_ONCE_SQL = f"""
  SELECT
    CASE WHEN event_type = 'click' THEN {_sql_base('user_id')} || '{VARIANT_SUFFIX}'
         ELSE {_sql_base('user_id')} END AS oblast,
    CASE WHEN lvl = 'raion' THEN CAST(k % 8 AS VARCHAR) END AS raion,
    CASE WHEN lvl = 'hromada' THEN CAST(k % 8 AS VARCHAR) END AS hromada,
    lvl AS level,
    CASE WHEN k = 0 THEN 'NOT_A_DATE' ELSE {_sql_fmt('ts')} END AS started_at,
    CASE WHEN k = 1 THEN NULL
         ELSE {_sql_fmt("ts + to_seconds(CAST(round(value * 60) AS BIGINT))")} END AS finished_at
  FROM (
    SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           CASE event_type WHEN 'error' THEN 'oblast' WHEN 'view' THEN 'hromada' ELSE 'raion' END AS lvl
    FROM events
  ) e
"""

RAW_ALERTS_SQL = f"""
SELECT *, 'primary' AS source FROM ({_RAW_ONCE_SQL}) r1
UNION ALL
SELECT *, 'mirror' AS source FROM ({_RAW_ONCE_SQL}) r2
"""

SECOND_SOURCE_SQL = f"""
SELECT CASE WHEN event_type = 'signup' THEN {_sql_base('user_id')} || '{VARIANT_SUFFIX}'
            ELSE {_sql_base('user_id')} END AS region,
       {_sql_fmt('ts')} AS started_at,
       event_type AS kind
FROM events
"""

ORDERS_SQL = f"""
af AS (
  SELECT {_sql_base('o_custkey')} AS region, o_orderdate AS started_at,
         timezone('Europe/Kyiv', timezone('UTC', o_orderdate)) AS local_start,
         CAST(timezone('Europe/Kyiv', timezone('UTC', o_orderdate)) AS DATE) AS date
  FROM orders)
"""

FEATURES_SQL = f"""
SELECT CASE WHEN n_regionkey = 1 THEN 'Elsewhere' ELSE 'Ukraine' END AS admin,
       CASE n_nationkey WHEN 0 THEN 'Kiev' WHEN 5 THEN 'Kiev City' ELSE n_name END AS name,
       {_sql_base('n_nationkey')} || '{VARIANT_SUFFIX}' AS name_uk, 'Point' AS geo_type,
       CAST(22.5 + n_nationkey AS DOUBLE) AS lon, CAST(45.25 + n_nationkey / 2.0 AS DOUBLE) AS lat
FROM nation
"""
