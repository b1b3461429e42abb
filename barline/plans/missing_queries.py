"""Registered queries: missing data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators import missing, series as S
from barline.plans import oracle as O
from barline.plans.registry import query
from barline.sources import fixtures as X

_KEYS = ["ticker", "frequency"]
FULL = """cal AS (SELECT ticker, unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS ts FROM sparse_bars GROUP BY ticker),
 f AS MATERIALIZED (SELECT c.ticker, c.ts, CAST(c.ts AS DATE) AS dt, s.close, s.volume FROM cal c LEFT JOIN sparse_bars s ON s.ticker = c.ticker AND s.ts = c.ts)"""
_P = "WINDOW p AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN {a} AND {b})"


def regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse bars on the full daily calendar, gaps empty."""
    return missing.regularise(X.sparse_bars(spark, sf_dir), _KEYS, "daily", ["close", "volume"])


def _out(df: DataFrame) -> DataFrame:
    return df.select("ticker", "ts", F.round("close", 4).alias("close"), "volume")


def _fill_sql(fn: str, a: str, b: str) -> str:
    return O.with_(O.SPARSE, FULL) + f"""SELECT ticker, ts, round(coalesce(close, {fn}(close IGNORE NULLS) OVER p), 4) AS close,
 coalesce(volume, {fn}(volume IGNORE NULLS) OVER p) AS volume FROM f """ + _P.format(a=a, b=b)


query("regularise", O.with_(O.SPARSE, FULL) + "SELECT ticker, ts, round(close, 4) AS close, volume FROM f")(
    lambda s, d: _out(regular(s, d)))
query("ffill_limit", _fill_sql("last_value", "2 PRECEDING", "1 PRECEDING"))(
    lambda s, d: _out(missing.ffill_limit(regular(s, d), S.bars(), ["close", "volume"], 2)))
query("ffill", _fill_sql("last_value", "UNBOUNDED PRECEDING", "CURRENT ROW"))(
    lambda s, d: _out(missing.ffill(regular(s, d), S.bars(), ["close", "volume"])))


def _holed(df: DataFrame) -> DataFrame:
    """Values removed on Mondays and at the start, so that backward filling has work."""
    hole = (F.weekday("ts") == 0) | (F.col("ts") < F.lit("1995-03-01").cast("timestamp"))
    return df.withColumns({n: F.when(~hole, F.col(n)) for n in ("close", "volume")})


_HOLED = """h AS (SELECT ticker, ts, dt, CASE WHEN NOT (isodow(ts) = 1 OR dt < DATE '1995-03-01') THEN close END AS close,
 CASE WHEN NOT (isodow(ts) = 1 OR dt < DATE '1995-03-01') THEN volume END AS volume FROM f)"""
query("bfill", O.with_(O.SPARSE, FULL, _HOLED) + """SELECT ticker, ts, round(coalesce(close, first_value(close IGNORE NULLS) OVER p), 4) AS close,
 coalesce(volume, first_value(volume IGNORE NULLS) OVER p) AS volume FROM h """ + _P.format(a="CURRENT ROW", b="UNBOUNDED FOLLOWING"))(
    lambda s, d: _out(missing.bfill(_holed(regular(s, d)), S.bars(), ["close", "volume"])))
query("mean_impute", O.with_(O.SPARSE, FULL) + """SELECT ticker, ts, round(coalesce(close, (SELECT avg(close) FROM f WHERE dt < DATE '2000-01-01')), 4) AS close,
 round(coalesce(volume, (SELECT avg(volume) FROM f WHERE dt < DATE '2000-01-01')), 6) AS volume FROM f""")(
    lambda s, d: (lambda df: missing.mean_impute(df, df.where("ts < TIMESTAMP '2000-01-01'"), ["close", "volume"]).select(
        "ticker", "ts", F.round("close", 4).alias("close"), F.round("volume", 6).alias("volume")))(regular(s, d)))
query("interpolate", O.with_(O.SPARSE, FULL, _HOLED) + """, g AS (SELECT ticker, ts, close, epoch(ts) AS t,
   last_value(CASE WHEN close IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER b AS t0, last_value(close IGNORE NULLS) OVER b AS v0,
   first_value(CASE WHEN close IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER a AS t1, first_value(close IGNORE NULLS) OVER a AS v1
  FROM h WINDOW b AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   a AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT ticker, ts, round(coalesce(close, v0 + (v1 - v0) * ((t - t0) / (t1 - t0))), 7) AS close FROM g""")(
    lambda s, d: missing.interpolate(_holed(regular(s, d)), S.bars(), "close").select(
        "ticker", "ts", F.round("close", 7).alias("close")))
query("max_gap_drop", O.with_(O.SPARSE, FULL) + """, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts)
   - row_number() OVER (PARTITION BY ticker, close IS NULL ORDER BY ts) AS grp FROM f),
 k AS (SELECT *, count(*) OVER (PARTITION BY ticker, close IS NULL, grp) AS len FROM n)
 SELECT ticker, ts, round(close, 4) AS close, volume FROM k WHERE close IS NOT NULL OR len <= 2""")(
    lambda s, d: _out(missing.max_gap_drop(regular(s, d), S.bars(), "close", 2)))
query("drop_missing", O.with_(O.SPARSE, FULL) + "SELECT ticker, ts, round(close, 4) AS close, volume FROM f WHERE close IS NOT NULL AND volume IS NOT NULL")(
    lambda s, d: _out(missing.drop_missing(regular(s, d), ["close", "volume"])))
