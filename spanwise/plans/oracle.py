"""DuckDB SQL that recomputes every registered query from the driver's tables.

The texts are independent formulations (plain windows, ``NOT EXISTS``, scalar
subqueries) of the same semantics, used only as a correctness oracle.
"""

from __future__ import annotations

from spanwise.config import Profile
from spanwise.sources.binding import RAW_ALERTS_SQL, SECOND_SOURCE_SQL, binding_profile


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_list(values) -> str:
    return ", ".join(_q(v) for v in values)


def pipeline_ctes(p: Profile | None = None) -> str:
    p = p or binding_profile()
    cap = p.cap_seconds
    aliases = ", ".join(f"({_q(k)}, {_q(v)})" for k, v in sorted(p.aliases.items()))
    excluded = _in_list(p.excluded) if p.excluded else "NULL"
    return f"""
raw AS ({RAW_ALERTS_SQL}),
dedup AS (SELECT DISTINCT oblast, raion, hromada, level, started_at, finished_at FROM raw),
parsed AS (
  SELECT oblast, raion, hromada, level,
         TRY_CAST(started_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS s,
         TRY_CAST(finished_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS e
  FROM dedup),
capped AS (
  SELECT oblast, raion, hromada, level, s AS started_at,
         CASE WHEN e IS NOT NULL AND date_diff('microsecond', s, e) > CAST({cap} AS BIGINT) * 1000000
              THEN s + to_seconds({cap}) ELSE e END AS finished_at
  FROM parsed WHERE s IS NOT NULL),
base AS (SELECT * FROM capped WHERE level IN ('oblast', 'raion')),
fine AS (SELECT * FROM capped WHERE level = 'hromada'),
uncovered AS (
  SELECT f.* FROM fine f
  WHERE f.oblast IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM base b
    WHERE b.oblast = f.oblast
      AND f.started_at < coalesce(b.finished_at, b.started_at + to_seconds({cap}))
      AND coalesce(f.finished_at, f.started_at + to_seconds({cap})) > b.started_at)),
alias_map(variant, canonical) AS (VALUES {aliases}),
units_all AS (
  SELECT u.*, coalesce(a.canonical, u.oblast) AS region
  FROM (SELECT * FROM base UNION ALL SELECT * FROM uncovered) u
  LEFT JOIN alias_map a ON a.variant = u.oblast),
units AS (
  SELECT oblast, raion, hromada, level, started_at, finished_at, region,
         CASE coalesce(level, 'oblast')
              WHEN 'oblast' THEN coalesce(region, '')
              WHEN 'raion' THEN coalesce(region, '') || '::' || coalesce(raion, '')
              ELSE coalesce(region, '') || '::' || coalesce(hromada, '') END AS unit_name
  FROM units_all WHERE region IS NULL OR region NOT IN ({excluded})),
ep_a AS (
  SELECT region, started_at AS s, finished_at AS e,
         coalesce(sum(CASE WHEN finished_at IS NULL THEN 1 ELSE 0 END) OVER (
           PARTITION BY region ORDER BY started_at, finished_at NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
  FROM units WHERE region IS NOT NULL),
ep_b AS (
  SELECT *, max(e) OVER (PARTITION BY region, seg ORDER BY s, e NULLS LAST
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
  FROM ep_a),
ep_c AS (
  SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (
           PARTITION BY region ORDER BY s, e NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gid
  FROM ep_b),
episodes AS (
  SELECT region, min(s) AS started_at,
         CASE WHEN bool_or(e IS NULL) THEN NULL ELSE max(e) END AS finished_at,
         count(*) AS n_records
  FROM ep_c GROUP BY region, gid),
episodes_d AS (
  SELECT region, started_at, finished_at,
         date_diff('microsecond', started_at, finished_at) / 60000000.0 AS duration_min
  FROM episodes),
frame AS (
  SELECT region, started_at, finished_at, duration_min, finished_at IS NULL AS censored,
         timezone({_q(p.tz)}, timezone('UTC', started_at)) AS local_start
  FROM episodes_d WHERE region IS NULL OR region NOT IN ({excluded})),
af AS (
  SELECT *, CAST(hour(local_start) AS INTEGER) AS hour,
         CAST(isodow(local_start) - 1 AS INTEGER) AS dow,
         dayname(local_start) AS dow_name,
         CAST(month(local_start) AS INTEGER) AS month,
         monthname(local_start) AS month_name,
         CAST(year(local_start) AS INTEGER) AS year,
         CAST(local_start AS DATE) AS date,
         CAST(weekofyear(local_start) AS INTEGER) AS week
  FROM frame),
second_raw AS ({SECOND_SOURCE_SQL})
"""


def with_pipeline(select_sql: str, p: Profile | None = None) -> str:
    return "WITH " + pipeline_ctes(p).strip() + "\n" + select_sql
