"""Shared DuckDB text: the input shapes as common table expressions."""

from __future__ import annotations

BARS = """bars AS MATERIALIZED (
 SELECT ticker, CAST(dt AS TIMESTAMP) AS ts, dt, 'daily' AS frequency,
   max(CASE WHEN rn = 1 THEN price END) AS open, max(price) AS high, min(price) AS low,
   max(CASE WHEN rn = n THEN price END) AS close, sum(qty) AS volume,
   sum(price * qty) / nullif(sum(qty), 0) AS vwap, count(*) AS transactions
 FROM (SELECT concat(l_returnflag, l_linestatus) AS ticker, CAST(l_shipdate AS DATE) AS dt,
   l_extendedprice AS price, l_quantity AS qty,
   row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_shipdate
     ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
   count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_shipdate) AS n
   FROM lineitem) GROUP BY ticker, dt)"""

SPARSE = """sparse_bars AS MATERIALIZED (
 SELECT o_orderpriority AS ticker, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts,
   CAST(o_orderdate AS DATE) AS dt, 'daily' AS frequency,
   avg(o_totalprice) AS close, CAST(count(*) AS DOUBLE) AS volume
 FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE))"""

ARTICLES = """articles AS MATERIALIZED (
 SELECT event_id AS article_id, CAST(ts AS TIMESTAMP) AS ts, CAST(ts AS DATE) AS dt,
   concat(CAST(mod(CAST(floor(value) AS BIGINT), 21) - 10 AS VARCHAR), ',',
     CAST(mod(CAST(floor(value) AS BIGINT), 7) AS VARCHAR), ',',
     CAST(mod(CAST(floor(value) AS BIGINT), 5) AS VARCHAR), ',',
     CAST(mod(CAST(floor(value) AS BIGINT), 7) + mod(CAST(floor(value) AS BIGINT), 5) AS VARCHAR), ',1,2',
     CASE WHEN event_type = 'error' THEN '' ELSE concat(',', regexp_extract(props, '([0-9]+)', 1)) END) AS v2tone,
   concat(upper(event_type), ';K', CAST(mod(user_id, 9) AS VARCHAR)) AS v2themes,
   CASE WHEN mod(user_id, 4) = 0 THEN '1#UK#' ELSE '1#US#' END AS v2locations,
   CAST(user_id AS VARCHAR) AS source
 FROM events)"""

PARSED = ARTICLES + """, parsed AS MATERIALIZED (
 SELECT *, TRY_CAST(split_part(v2tone, ',', 1) AS DOUBLE) AS tone,
   TRY_CAST(split_part(v2tone, ',', 2) AS DOUBLE) AS positive,
   TRY_CAST(split_part(v2tone, ',', 3) AS DOUBLE) AS negative,
   TRY_CAST(split_part(v2tone, ',', 4) AS DOUBLE) AS polarity,
   TRY_CAST(split_part(v2tone, ',', 7) AS BIGINT) AS word_count FROM articles)"""

TICKS = """ticks AS MATERIALIZED (
 SELECT event_type AS ticker, CAST(ts AS TIMESTAMP) AS ts, event_id, value AS price,
   CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS volume FROM events)"""

TRENDS = """trends AS MATERIALIZED (
 SELECT dt, keyword, CAST(floor(100.0 * n / max(n) OVER (PARTITION BY keyword)) AS DOUBLE) AS interest
 FROM (SELECT event_type AS keyword, CAST(ts AS DATE) AS dt, count(*) AS n
       FROM events GROUP BY event_type, CAST(ts AS DATE)))"""

PREDICTIONS = BARS + """, b AS (SELECT ticker, dt, close,
   row_number() OVER (PARTITION BY ticker ORDER BY dt) AS sample_id,
   lead(close, 7) OVER (PARTITION BY ticker ORDER BY dt) AS f7, lag(close, 7) OVER (PARTITION BY ticker ORDER BY dt) AS l7,
   lead(close, 14) OVER (PARTITION BY ticker ORDER BY dt) AS f14, lag(close, 14) OVER (PARTITION BY ticker ORDER BY dt) AS l14
   FROM bars), predictions AS MATERIALIZED (
 SELECT ticker, dt, sample_id, 7 AS horizon, f7 / close - 1 AS y, close / l7 - 1 AS yhat FROM b
   WHERE f7 IS NOT NULL AND l7 > 0 AND close > 0
 UNION ALL
 SELECT ticker, dt, sample_id, 14 AS horizon, f14 / close - 1 AS y, close / l14 - 1 AS yhat FROM b
   WHERE f14 IS NOT NULL AND l14 > 0 AND close > 0)"""

SCALARS = """run_scalars AS MATERIALIZED (
 SELECT concat('reg_md0.', CAST(mod(user_id, 3) AS VARCHAR), '_wd0.0', CAST(mod(user_id, 5) AS VARCHAR),
     '_gc0.5_fd0.', CAST(user_id AS VARCHAR)) AS run,
   CASE event_type WHEN 'click' THEN 'Loss/val' WHEN 'view' THEN 'Metrics/MAE'
     WHEN 'signup' THEN 'Metrics/DirectionalAccuracy' WHEN 'purchase' THEN 'Metrics/PerHorizon/H7_MAE'
     ELSE 'Metrics/PerHorizon/H14_MAE' END AS tag,
   row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS step, value FROM events)"""

NUMBERED = BARS + """, s AS MATERIALIZED (
 SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS rn FROM bars)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(ctes) + " "


def guard(agg: str, column: str, n: int, partition: str = "PARTITION BY ticker ORDER BY dt") -> str:
    """Full-window aggregate: NULL until the frame holds ``n`` values."""
    frame = f"OVER ({partition} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) {frame} = {n} THEN {agg}({column}) {frame} END"
