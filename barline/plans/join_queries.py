"""Registered queries: joins, merges and table maintenance (JN1-JN12, M1-M9, D1-D2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions import text, timeops
from barline.operators import indicators as I, joins as J, merge as M, quality, sentiment, series as S
from barline.plans import oracle as O
from barline.plans.filter_queries import BUCKETS, VERSIONS, two_versions
from barline.plans.registry import query
from barline.session import work_dir
from barline.sources import fixtures as X
from barline.sources import writers

W = "OVER (PARTITION BY ticker ORDER BY dt)"
_SMA10 = O.guard("avg", "close", 10)


def _indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored indicators: from mid 1995 on, under the other spelling of the frequency."""
    out = I.indicator_set(X.bars(spark, sf_dir), ["sma_10"]).where("dt >= DATE '1995-06-01'")
    return out.select("ticker", "ts", F.lit("1d").alias("frequency"), "sma_10")


_IND = f"ind AS (SELECT * FROM (SELECT ticker, ts, '1d' AS frequency, dt, {_SMA10} AS sma_10 FROM bars) WHERE dt >= DATE '1995-06-01')"


@query("join_bars_indicators", O.with_(O.BARS, _IND) + """SELECT b.ticker, b.dt, b.close, round(i.sma_10, 6) AS sma_10
 FROM bars b JOIN ind i ON b.ticker = i.ticker AND b.ts = i.ts""")
def join_bars_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.join_bars_indicators(X.bars(spark, sf_dir), _indicators(spark, sf_dir)).select(
        "ticker", "dt", "close", F.round("sma_10", 6).alias("sma_10"))


def shared_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sentiment, moved back in time so that it overlaps the bars."""
    daily = sentiment.resample(sentiment.sentiment_15m(text.parse_tone(X.articles(spark, sf_dir))), "1d")
    shifted = F.timestamp_seconds(F.unix_seconds("ts") - 10_000 * 86_400)
    return daily.withColumn("ts", shifted)


SHARED = BUCKETS + """, shared AS MATERIALIZED (SELECT date_trunc('day', ts) - INTERVAL 10000 DAY AS ts,
   avg(weighted_avg_tone) AS weighted_avg_tone, avg(weighted_avg_positive) AS weighted_avg_positive,
   avg(weighted_avg_negative) AS weighted_avg_negative, avg(weighted_avg_polarity) AS weighted_avg_polarity,
   CAST(sum(num_articles) AS BIGINT) AS num_articles, CAST(sum(num_sources) AS BIGINT) AS num_sources FROM b GROUP BY 1)"""


@query("join_sentiment", O.with_(O.BARS, SHARED) + """SELECT b.ticker, b.dt, b.close, round(s.weighted_avg_tone, 6) AS weighted_avg_tone,
 s.num_articles FROM bars b LEFT JOIN shared s ON b.ts = s.ts""")
def join_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.join_shared(X.bars(spark, sf_dir), shared_daily(spark, sf_dir)).select(
        "ticker", "dt", "close", F.round("weighted_avg_tone", 6).alias("weighted_avg_tone"), "num_articles")


@query("join_basket", O.with_(O.BARS) + """, k AS (SELECT ts, avg(close) AS basket_close, count(close) AS members FROM bars
   WHERE ticker IN ('AF', 'NF', 'RF') GROUP BY ts)
 SELECT b.ticker, b.dt, b.close, round(k.basket_close, 6) AS basket_close, k.members FROM bars b LEFT JOIN k ON b.ts = k.ts""")
def join_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = X.bars(spark, sf_dir)
    return J.join_shared(bars, quality.basket_mean(bars, X.BASKET)).select(
        "ticker", "dt", "close", F.round("basket_close", 6).alias("basket_close"), "members")


_KEYS = ["ticker", "ts"]


@query("align_full_outer", O.with_(O.BARS, O.SPARSE) + """, a AS (SELECT ticker, ts FROM bars WHERE dt < DATE '2001-06-01'),
   c AS (SELECT ticker, ts FROM bars WHERE dt >= DATE '1995-06-01')
 SELECT count(*) FILTER (a.ts IS NOT NULL AND c.ts IS NOT NULL) AS aligned, count(*) FILTER (c.ts IS NULL) AS left_only,
   count(*) FILTER (a.ts IS NULL) AS right_only FROM a FULL JOIN c ON a.ticker = c.ticker AND a.ts = c.ts""")
def align_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = X.bars(spark, sf_dir)
    return J.alignment_counts(bars.where("dt < DATE '2001-06-01'"), bars.where("dt >= DATE '1995-06-01'"), _KEYS)


@query("raw_only_anti", O.with_(O.SPARSE) + """SELECT ticker, dt, volume FROM sparse_bars s WHERE NOT EXISTS
  (SELECT 1 FROM sparse_bars r WHERE r.volume >= 2 AND r.ticker = s.ticker AND r.ts = s.ts) ORDER BY ticker, dt LIMIT 10""")
def raw_only_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.sparse_bars(spark, sf_dir)
    return J.raw_only(rows, rows.where("volume >= 2"), _KEYS).select("ticker", "dt", "volume")


_SPINE = O.SPARSE + """, cal AS (SELECT ticker, unnest(generate_series(CAST(min(dt) AS TIMESTAMP), CAST(max(dt) AS TIMESTAMP),
   INTERVAL 1 DAY)) AS ts FROM sparse_bars GROUP BY ticker)"""


@query("expected_vs_actual", O.with_(_SPINE) + """SELECT c.ticker, count(*) AS expected, count(s.ts) AS actual,
   count(*) - count(s.ts) AS missing, round(100.0 * count(s.ts) / count(*), 6) AS complete_pct,
   100.0 * count(s.ts) / count(*) >= 95 AS passes
 FROM cal c LEFT JOIN sparse_bars s ON s.ticker = c.ticker AND s.ts = c.ts GROUP BY c.ticker""")
def expected_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.expected_vs_actual(X.sparse_bars(spark, sf_dir), ["ticker"], "daily").withColumn(
        "complete_pct", F.round("complete_pct", 6))


_SLOTS = BUCKETS + """, gone AS (SELECT ts FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTE)) AS ts FROM b)
   EXCEPT SELECT ts FROM b)"""


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = X.articles(spark, sf_dir).select(timeops.bucket_15m(F.col("ts")).alias("ts"))
    return J.missing_intervals(buckets, [], "15m")


query("missing_intervals", O.with_(_SLOTS) + "SELECT ts, dayname(ts) AS day_name, hour(ts) AS hour FROM gone")(_gone)
query("missing_by_hour", O.with_(_SLOTS) + "SELECT hour(ts) AS hour, count(*) AS n FROM gone GROUP BY 1")(
    lambda s, d: _gone(s, d).groupBy("hour").agg(F.count("*").alias("n")))

query("compare_join", O.with_(O.BARS, VERSIONS) + """SELECT ticker, dt, round(sma_10_computed, 6) AS sma_10_computed,
 round(sma_10_stored, 6) AS sma_10_stored FROM pair""")(
    lambda s, d: two_versions(s, d).select("ticker", "dt", F.round("sma_10_computed", 6).alias("sma_10_computed"),
                                           F.round("sma_10_stored", 6).alias("sma_10_stored")))


@query("combined_export", O.with_(O.BARS, _IND) + """SELECT b.ticker, b.ts, '1d' AS frequency, b.close, b.volume,
 round(i.sma_10, 6) AS sma_10, 'computed' AS source FROM bars b LEFT JOIN ind i ON b.ticker = i.ticker AND b.ts = i.ts""")
def combined_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = J.canonical_keys(X.bars(spark, sf_dir)).select("ticker", "ts", "frequency", "close", "volume")
    out = J.combined_export(bars, _indicators(spark, sf_dir), ["sma_10"], {"source": "computed"})
    return out.withColumn("sma_10", F.round("sma_10", 6))


@query("set_missing_keys", O.with_(O.BARS) + """SELECT DISTINCT k AS ticker FROM (SELECT event_type AS k FROM events
   UNION ALL SELECT ticker FROM bars) WHERE k NOT IN (SELECT ticker FROM bars WHERE dt < DATE '1996-01-01')""")
def set_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = X.bars(spark, sf_dir)
    asked = X.table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker")).unionByName(bars.select("ticker"))
    return J.missing_keys(asked, bars.where("dt < DATE '1996-01-01'"), ["ticker"])


@query("asof_backward", """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
  r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase')
 SELECT l.event_id, l.user_id, l.ts, r.value AS value_asof, r.ts AS matched_ts
 FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    left = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return J.asof_backward(left, right, ["user_id"], ["value"], S.timed(("user_id",), ("ts",)))


@query("hp_grid", O.with_(O.SCALARS) + """SELECT run, d_model, n_layers, d_ff FROM (
   SELECT run, d_model, n_layers, 4 * d_model AS d_ff FROM (SELECT DISTINCT run FROM run_scalars),
     (SELECT unnest([32, 64, 128]) AS d_model), (SELECT unnest([1, 2]) AS n_layers))""")
def hp_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = X.run_scalars(spark, sf_dir).select("run").distinct()
    return J.parameter_grid(started, {"d_model": [32, 64, 128], "n_layers": [1, 2]},
                            tied={"d_ff": F.col("d_model") * 4})


def _u(name: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '42', '{name}', run, CAST(draw AS VARCHAR))), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE)"


@query("hp_draws", O.with_(O.SCALARS) + f"""SELECT run, CAST(draw AS INTEGER) AS draw, round(pow(10.0::DOUBLE, -5 + {_u('lr')} * 3), 9) AS lr,
   round(0.5 * {_u('dropout')}, 9) AS dropout, [32, 64, 128][CAST(floor({_u('d_model')} * 3) AS INTEGER) + 1] AS d_model
 FROM (SELECT DISTINCT run FROM run_scalars), (SELECT unnest(range(1, 21)) AS draw)""")
def hp_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty random settings a run, learning rates even by magnitude."""
    started = X.run_scalars(spark, sf_dir).select("run").distinct()
    drawn = J.parameter_draws(started, ["run"], 20, {"lr": (-5, -2)}, {"dropout": (0.0, 0.5)}, {"d_model": [32, 64, 128]})
    return drawn.withColumns({n: F.round(n, 9) for n in ("lr", "dropout")})


# --- merges ------------------------------------------------------------------

_COLS = ["ticker", "ts", "frequency", "close", "volume"]


def _staging(bars: DataFrame) -> DataFrame:
    hole = F.unix_date("dt") % 7 == 0
    return bars.where("dt >= DATE '2000-07-01'").select(
        "ticker", "ts", "frequency", F.when(~hole, F.col("close") * 1.01).alias("close"), "volume", "dt")


def _main(bars: DataFrame) -> DataFrame:
    return bars.where("dt < DATE '2001-01-01'").select(*_COLS, "dt")


def _merged(spark: SparkSession, bars: DataFrame, staged: DataFrame, mode: str) -> DataFrame:
    """A stored table after the stored staging rows were merged into it."""
    path, staging = work_dir(spark, "bars"), work_dir(spark, "staging")
    writers.write_bars(_main(bars), path)
    staged.write.parquet(staging)
    writers.merge_into(spark, path, staging, mode)
    return writers.read_table(spark, path)


def _changed(spark: SparkSession, bars: DataFrame, test: Column, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stored table after ``change`` of the partitions with rows that meet ``test``."""
    path = work_dir(spark, "bars")
    writers.write_bars(bars, path)
    writers.change_rows(spark, path, test, change, writers.BAR_SORT)
    return writers.read_table(spark, path)


def _out(df: DataFrame) -> DataFrame:
    return df.select("ticker", "dt", F.round("close", 4).alias("close"), "volume")


_ST = """st AS (SELECT ticker, ts, dt, CASE WHEN date_diff('day', DATE '1970-01-01', dt) % 7 <> 0 THEN close * 1.01::DOUBLE END AS close,
   volume FROM bars WHERE dt >= DATE '2000-07-01'), mn AS (SELECT ticker, ts, dt, close, volume FROM bars WHERE dt < DATE '2001-01-01')"""
_M = O.with_(O.BARS, _ST)
_SEL = "SELECT ticker, dt, round(close, 4) AS close, volume FROM "
_ANTI = "(SELECT * FROM mn WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.ticker = mn.ticker AND st.ts = mn.ts)"


@query("merge_upsert", _M + _SEL + _ANTI + " UNION ALL SELECT * FROM st)")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = X.bars(spark, sf_dir)
    return _out(_merged(spark, bars, _staging(bars), "upsert"))


@query("merge_coalesce", _M + """SELECT coalesce(st.ticker, mn.ticker) AS ticker, coalesce(st.dt, mn.dt) AS dt,
   round(coalesce(st.close, mn.close), 4) AS close, coalesce(st.volume, mn.volume) AS volume
 FROM mn FULL JOIN st ON st.ticker = mn.ticker AND st.ts = mn.ts""")
def merge_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = X.bars(spark, sf_dir)
    return _out(_merged(spark, bars, _staging(bars), "coalesce"))


@query("merge_insert_only", _M + _SEL + """(SELECT * FROM mn UNION ALL
   SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM mn WHERE st.ticker = mn.ticker AND st.ts = mn.ts))""")
def merge_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = X.bars(spark, sf_dir)
    staged = _staging(bars).withColumn("ingested_at", F.lit(2))
    twice = staged.unionByName(staged.withColumns({"ingested_at": F.lit(1), "close": F.col("close") * 0}))
    return _out(_merged(spark, bars, twice, "insert"))


_YEAR_M = O.with_(O.BARS)


@query("delete_by_key_range", _YEAR_M + """SELECT ticker, dt, close FROM bars WHERE NOT (ticker IN ('AF', 'NO')
   AND dt BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND frequency = 'daily')""")
def delete_by_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes from a stored table: only the touched years are rewritten."""
    test = M.in_range(["AF", "NO"], "1997-01-01", "1998-12-31", "daily")
    return _changed(spark, X.bars(spark, sf_dir), test, lambda df: M.delete_where(df, test)).select("ticker", "dt", "close")


@query("null_out_columns", O.with_(O.BARS) + """SELECT ticker, dt, close, CASE WHEN ticker IN ('AF') AND dt BETWEEN DATE '1997-01-01'
   AND DATE '1997-12-31' THEN NULL ELSE volume END AS volume FROM bars""")
def null_out_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = M.in_range(["AF"], "1997-01-01", "1997-12-31", None)
    change = lambda df: M.null_out_columns(df, ["volume"], test)
    return _changed(spark, X.bars(spark, sf_dir), test, change).select("ticker", "dt", "close", "volume")


query("purge", O.with_(O.BARS) + "SELECT ticker, dt, close FROM bars WHERE ticker NOT IN ('AO', 'RO')")(
    lambda s, d: _changed(s, X.bars(s, d), M.in_range(["AO", "RO"], None, None, None), lambda df: M.purge(df, ["AO", "RO"]))
    .select("ticker", "dt", "close"))
query("high_water_mark", O.with_(O.BARS) + """SELECT ticker, frequency, max(ts) AS last_ts, max(ts) + INTERVAL 1 DAY AS next_start
 FROM bars GROUP BY ticker, frequency""")(lambda s, d: M.high_water_mark(X.bars(s, d)))


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = X.bars(spark, sf_dir)
    names = bars.select("ticker").distinct().unionByName(
        X.table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker")).distinct())
    return names.withColumn("frequency", F.lit("daily"))


_WORK = """work AS (SELECT DISTINCT ticker FROM bars UNION SELECT DISTINCT event_type FROM events),
 held AS (SELECT ticker, max(ts) AS last_ts FROM bars WHERE NOT (ticker LIKE 'R%' AND dt >= DATE '2000-01-01') GROUP BY ticker)"""


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.bars(spark, sf_dir).where("NOT (ticker LIKE 'R%' AND dt >= DATE '2000-01-01')")


query("exists_check", O.with_(O.BARS, _WORK) + """SELECT w.ticker, 'daily' AS frequency, h.ticker IS NOT NULL AS has_data
 FROM work w LEFT JOIN held h ON h.ticker = w.ticker""")(
    lambda s, d: M.exists_check(_work(s, d), _held(s, d)))
query("topup_plan", O.with_(O.BARS, _WORK) + """SELECT w.ticker, 'daily' AS frequency,
   CASE WHEN last_ts IS NULL THEN 'load' WHEN last_ts + INTERVAL 1 DAY > TIMESTAMP '2001-06-30' THEN 'skip' ELSE 'top_up' END AS action,
   CASE WHEN last_ts IS NULL THEN TIMESTAMP '1995-01-01' WHEN last_ts + INTERVAL 1 DAY <= TIMESTAMP '2001-06-30' THEN last_ts + INTERVAL 1 DAY END AS start_ts,
   CASE WHEN last_ts IS NULL OR last_ts + INTERVAL 1 DAY <= TIMESTAMP '2001-06-30' THEN TIMESTAMP '2001-06-30' END AS end_ts
 FROM work w LEFT JOIN held h ON h.ticker = w.ticker""")(
    lambda s, d: M.topup_plan(_work(s, d), _held(s, d), "1995-01-01", "2001-06-30"))


def _copies(bars: DataFrame) -> DataFrame:
    """Overlapping chunks of one feed: the years 1998-1999 arrive twice."""
    return bars.withColumn("chunk_no", F.lit(1)).unionByName(
        bars.where("year(dt) IN (1998, 1999)").withColumns({"close": F.col("close") + 1, "chunk_no": F.lit(2)}))


_LAST = """SELECT ticker, dt, CASE WHEN year(dt) IN (1998, 1999) THEN close + {x} ELSE close END AS close FROM bars"""
query("dedupe_keep_last", O.with_(O.BARS) + _LAST.format(x=1))(
    lambda s, d: M.dedupe(_copies(X.bars(s, d)), M.KEY, ["chunk_no"]).select("ticker", "dt", "close"))
query("dedupe_keep_first", O.with_(O.BARS) + _LAST.format(x=0))(
    lambda s, d: M.dedupe(_copies(X.bars(s, d)), M.KEY, ["chunk_no"], keep="first").select("ticker", "dt", "close"))
