"""Registered queries: streaming forms, run over everything available (ST1-ST8).

Appending queries emit a window once the watermark (latest event time minus the
delay) has passed its end; the oracle text keeps exactly those windows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.text import parse_tone
from barline.operators import sentiment as N
from barline.plans import oracle as O
from barline.plans.aggregate_queries import _OUT, _out
from barline.plans.filter_queries import BUCKETS
from barline.plans.indicator_queries import ewm_oracle
from barline.plans.registry import query
from barline.session import work_dir
from barline.sources import fixtures as X
from barline.streaming import feeds
from barline.streaming.indicators import stream_indicators
from barline.streaming.stored import indicators_into, ledger

W = "OVER (PARTITION BY ticker ORDER BY dt)"
_MARK = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _collect(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    base = work_dir(spark, label)
    feeds.run_to_table(stream, f"{base}/rows", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_tone(X.articles_from(X.events_stream(spark, sf_dir)))


@query("stream_sentiment_15m", O.with_(BUCKETS) + f"SELECT ts, {_OUT} FROM b WHERE ts + INTERVAL 15 MINUTE <= {_MARK}")
def stream_sentiment_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = feeds.closed_window(feeds.sentiment_15m(_parsed(spark, sf_dir)), "ts")
    return _out(_collect(spark, stream, "sentiment"), "ts")


_AVG = ", ".join(f"round(avg({n}), 6) + 0.0 AS {n}" for n in N.AVERAGES)
_SUM = ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in ("num_articles", "num_sources", "total_word_count"))


@query("stream_rollup", O.with_(BUCKETS) + f"""SELECT date_trunc('day', ts) AS ts, {_AVG}, min(min_tone) AS min_tone, max(max_tone) AS max_tone, {_SUM}
 FROM b GROUP BY 1 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_MARK}""")
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = feeds.closed_window(feeds.rollup(feeds.sentiment_15m(_parsed(spark, sf_dir))), "ts")
    return _out(_collect(spark, stream, "rollup"), "ts")


@query("stream_ohlc", O.with_(O.TICKS) + f"""SELECT ticker, time_bucket(INTERVAL 1 HOUR, ts) AS bar_ts, arg_min(price, (ts, event_id)) AS open,
   max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, sum(volume) AS volume, count(*) AS transactions
 FROM ticks GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_MARK}""")
def stream_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = feeds.closed_window(feeds.ohlc(X.ticks_from(X.events_stream(spark, sf_dir))), "bar_ts")
    return _collect(spark, stream, "ohlc").drop("vwap")


def _arrivals(df: DataFrame, path: str, bounds: list[str | None]) -> Iterator[None]:
    """Land consecutive time ranges as files, pausing after each."""
    for low, high in zip(bounds, bounds[1:]):
        part = df if low is None else df.where(F.col("ts") >= F.lit(low).cast("timestamp"))
        part = part if high is None else part.where(F.col("ts") < F.lit(high).cast("timestamp"))
        part.write.mode("append").parquet(path)
        yield


_WEEKS = [None, "2024-01-08", "2024-01-15", "2024-01-22", None]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _feed(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    return spark.readStream.schema(df.schema).parquet(path)


@query("stream_upsert", """SELECT user_id, CAST(ts AS DATE) AS dt, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id,
   arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, events = work_dir(spark, "upsert"), _events(spark, sf_dir)
    each = feeds.upsert_into(
        f"{base}/table", "dt", ["user_id", "dt"], ["ts", "event_id"],
        lambda df: df.select("user_id", F.to_date("ts").alias("dt"), "ts", "event_id", "value"))
    for _ in _arrivals(events, f"{base}/landed", _WEEKS):
        feeds.run_batches(_feed(spark, events, f"{base}/landed"), each, f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table")


_WEEK_OF = "CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 0 WHEN ts < TIMESTAMP '2024-01-15' THEN 1 WHEN ts < TIMESTAMP '2024-01-22' THEN 2 ELSE 3 END"


@query("stream_commits", f"""SELECT CAST({_WEEK_OF} AS BIGINT) AS batch_id, count(DISTINCT (user_id, CAST(ts AS DATE))) AS n_rows FROM events GROUP BY 1""")
def stream_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a table kept by upserts: rows of each batch after duplicates went."""
    base, events = work_dir(spark, "commits"), _events(spark, sf_dir)
    each = feeds.upsert_into(
        f"{base}/table", "dt", ["user_id", "dt"], ["ts", "event_id"],
        lambda df: df.select("user_id", F.to_date("ts").alias("dt"), "ts", "event_id", "value"))
    for _ in _arrivals(events, f"{base}/landed", _WEEKS):
        feeds.run_batches(_feed(spark, events, f"{base}/landed"), each, f"{base}/checkpoint")
    return feeds.commits(spark, f"{base}/table")


@query("stream_late_counts", f"""WITH a AS (SELECT ts, time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, CASE {_WEEK_OF} WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE {_WEEK_OF} END AS turn FROM events),
 m AS (SELECT turn, max(ts) AS latest FROM a GROUP BY turn)
 SELECT bucket AS ts, count(*) FILTER (NOT is_late) AS on_time, count(*) FILTER (is_late) AS late
 FROM (SELECT bucket, coalesce(bucket + INTERVAL 15 MINUTE <= (SELECT max(latest) FROM m WHERE m.turn < a.turn) - INTERVAL 1 HOUR, false) AS is_late FROM a) GROUP BY bucket""")
def stream_late_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles on time and late by interval, where the third week arrives before the second."""
    base, events = work_dir(spark, "late"), _events(spark, sf_dir)
    weeks = [(None, "2024-01-08"), ("2024-01-15", "2024-01-22"), ("2024-01-08", "2024-01-15"), ("2024-01-22", None)]
    for week in weeks:
        for _ in _arrivals(events, f"{base}/landed", list(week)):
            feeds.run_batches(_feed(spark, events, f"{base}/landed"), feeds.watch_late(f"{base}/seen"), f"{base}/checkpoint")
    return feeds.late_counts(spark, f"{base}/seen")


@query("stream_topup", "SELECT event_id, ts, value FROM events")
def stream_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several runs with one checkpoint: each reads only the files landed since."""
    base, events = work_dir(spark, "topup"), _events(spark, sf_dir)
    rows = events.select("event_id", "ts", "value")
    for _ in _arrivals(rows, f"{base}/landed", _WEEKS):
        feeds.run_to_table(_feed(spark, rows, f"{base}/landed"), f"{base}/rows", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/rows")


@query("stream_dedupe", "SELECT event_id, ts, value FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = X.events_stream(spark, sf_dir).select("event_id", "ts", "value")
    return _collect(spark, feeds.deduplicated(stream.unionByName(stream), ["event_id"]), "dedupe")


@query("stream_indicators", ewm_oracle() + f""", x AS (SELECT ticker, ts, close, {O.guard('avg', 'close', 10)} AS sma_10, CASE WHEN lag(close, 1) {W} IS NULL THEN volume
   WHEN close > lag(close, 1) {W} THEN volume WHEN close < lag(close, 1) {W} THEN -volume ELSE 0 END AS flow, rn FROM s)
 SELECT x.ticker, x.ts, x.close, round(sma_10, 4) AS sma_10, round(CASE WHEN x.rn >= 12 THEN e12 END, 4) AS ema_12,
   sum(flow) OVER (PARTITION BY x.ticker ORDER BY x.ts) + 0.0 AS obv FROM x JOIN e ON e.ticker = x.ticker AND e.rn = x.rn""")
def stream_indicators_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_dir(spark, "indicators")
    bars = X.bars(spark, sf_dir).select("ticker", "ts", "close", "volume")
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        for _ in _arrivals(bars, f"{base}/landed", [None, "1997-01-01", "2000-01-01", None]):
            stream = stream_indicators(_feed(spark, bars, f"{base}/landed"))
            feeds.run_to_table(stream, f"{base}/rows", f"{base}/checkpoint")
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    return spark.read.parquet(f"{base}/rows").withColumns(
        {n: F.round(n, 4) for n in ("sma_10", "ema_12")})


_LIVE = ["returns", "volatility_20", "sma_200", "volume_ratio", "bb_width", "atr_14", "ema_26", "macd_signal", "obv"]
_OUT_OF_ORDER = [(None, "1997-01-01"), ("1998-01-01", "2000-01-01"), ("1997-01-01", "1998-01-01"), ("2000-01-01", None)]


def _live(spark: SparkSession, sf_dir: str, names: list[str]) -> str:
    """Bars landed out of order, with their indicators kept in a table; its folder."""
    base = work_dir(spark, "live")
    bars = X.bars(spark, sf_dir).select("ticker", "frequency", "ts", "open", "high", "low", "close", "volume")
    each = indicators_into(f"{base}/table", names)
    for bounds in _OUT_OF_ORDER:
        for _ in _arrivals(bars, f"{base}/landed", list(bounds)):
            feeds.run_batches(_feed(spark, bars, f"{base}/landed"), each, f"{base}/checkpoint")
    return f"{base}/table"


@query("stream_indicator_set", ewm_oracle() + f""", f AS (SELECT *, close / lag(close, 1) {W} - 1 AS returns,
  CASE WHEN lag(close, 1) {W} IS NOT NULL THEN greatest(high - low, abs(high - lag(close, 1) {W}), abs(low - lag(close, 1) {W})) END AS tr,
  CASE WHEN lag(close, 1) {W} IS NULL THEN volume WHEN close > lag(close, 1) {W} THEN volume
    WHEN close < lag(close, 1) {W} THEN -volume ELSE 0 END AS flow FROM s),
 x AS (SELECT ticker, rn, ts, close, returns, {O.guard('stddev_samp', 'returns', 20)} AS volatility_20, {O.guard('avg', 'close', 200)} AS sma_200,
   volume / nullif({O.guard('avg', 'volume', 10)}, 0) AS volume_ratio,
   4 * ({O.guard('stddev_samp', 'close', 20)}) / nullif({O.guard('avg', 'close', 20)}, 0) AS bb_width,
   {O.guard('avg', 'tr', 14)} AS atr_14, sum(flow) {W} + 0.0 AS obv FROM f)
 SELECT x.ticker, x.ts, x.close, round(returns, 6) AS returns, round(volatility_20, 6) AS volatility_20, round(sma_200, 6) AS sma_200,
   round(volume_ratio, 6) AS volume_ratio, round(bb_width, 6) AS bb_width, round(atr_14, 6) AS atr_14,
   round(CASE WHEN x.rn >= 26 THEN e26 END, 4) AS ema_26, round(CASE WHEN x.rn >= 34 THEN sig END, 4) AS macd_signal, round(obv, 4) + 0.0 AS obv
 FROM x JOIN e ON e.ticker = x.ticker AND e.rn = x.rn""")
def stream_indicator_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{_live(spark, sf_dir, _LIVE)}/rows")
    return rows.select("ticker", "ts", "close", *[(F.round(n, 4 if n in ("ema_26", "macd_signal", "obv") else 6) + F.lit(0.0)).alias(n) for n in _LIVE])


_TURN = "CASE WHEN dt < DATE '1997-01-01' THEN 0 WHEN dt < DATE '1998-01-01' THEN 2 WHEN dt < DATE '2000-01-01' THEN 1 ELSE 3 END"


@query("stream_indicator_ledger", O.with_(O.BARS, f"""t AS (SELECT ticker, dt, CAST({_TURN} AS BIGINT) AS turn FROM bars),
 m AS (SELECT ticker, turn, min(dt) AS first_dt, max(dt) AS last_dt FROM t GROUP BY ticker, turn),
 w AS (SELECT t.turn, t.dt <= (SELECT max(last_dt) FROM m WHERE m.ticker = t.ticker AND m.turn < t.turn) AS is_late FROM t),
 c AS (SELECT m.turn, count(*) AS n FROM m JOIN t ON t.ticker = m.ticker AND t.turn < m.turn AND t.dt > m.first_dt GROUP BY m.turn)""") + """
 SELECT w.turn AS batch_id, count(*) AS n_rows, count(*) FILTER (is_late) AS n_late, coalesce(max(c.n), 0) AS n_corrected, CAST(0 AS BIGINT) AS n_skipped
 FROM w LEFT JOIN c ON c.turn = w.turn GROUP BY w.turn""")
def stream_indicator_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each batch, those that came late, and the stored ones corrected because of them."""
    return ledger(spark, _live(spark, sf_dir, ["sma_10", "obv"]))


@query("stream_gap_alert", f"""WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events
   WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS sess FROM d)
 SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM g GROUP BY user_id, sess
 HAVING max(ts) + INTERVAL 6 HOUR <= {_MARK}""")
def stream_gap_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = feeds.quiet_periods(X.events_stream(spark, sf_dir).select("user_id", "ts"), ["user_id"], "6 hours")
    return _collect(spark, stream, "gaps").drop("session")
