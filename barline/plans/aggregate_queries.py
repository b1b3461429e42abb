"""Registered queries: aggregations, coverage and gap reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions import text
from barline.operators import describe as D
from barline.operators import filters, indicators as I, missing, quality as Q, sentiment as N, series as S
from barline.plans import oracle as O
from barline.plans.filter_queries import BUCKETS
from barline.plans.registry import query
from barline.sources import fixtures as X

W = "OVER (PARTITION BY ticker ORDER BY dt)"
_VALUES = [*N.AVERAGES, "min_tone", "max_tone"]
_COUNTS = ["num_articles", "num_sources", "total_word_count"]
_OUT = ", ".join([f"round({v}, 6) + 0.0 AS {v}" for v in _VALUES] + _COUNTS)
GROUPS = {"shop": ["purchase", "click"], "other": ["view", "signup", "error"]}


def _out(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(v, 6).alias(v) for v in _VALUES], *_COUNTS)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.parse_tone(X.articles(spark, sf_dir))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.sentiment_15m(parsed(spark, sf_dir))


_US = BUCKETS.replace("FROM parsed GROUP BY 1", """FROM parsed WHERE v2locations LIKE '%#US#%'
   AND (contains(v2themes, 'PURCHASE') OR contains(v2themes, 'CLICK')) AND length(v2tone) > 0 GROUP BY 1""")
query("sentiment_15m", O.with_(_US) + f"SELECT ts, {_OUT} FROM b")(
    lambda s, d: _out(N.sentiment_15m(N.select_articles(X.articles(s, d), ["purchase", "click"])), "ts"))

_BIN = {"1h": "time_bucket(INTERVAL 1 HOUR, ts)", "4h": "time_bucket(INTERVAL 4 HOUR, ts)", "1d": "date_trunc('day', ts)",
        "1w": "CAST(CAST(ts AS DATE) + CAST(mod(7 - isodow(ts), 7) AS INTEGER) AS TIMESTAMP)"}
_METHOD = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "first": "arg_min({c}, ts)", "last": "arg_max({c}, ts)"}


def _resample_sql(freq: str, method: str, source: str = "b") -> str:
    cols = ", ".join(f"round({_METHOD[method].format(c=c)}, 6) + 0.0 AS {c}" for c in N.AVERAGES)
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _COUNTS)
    return f"""SELECT {_BIN[freq]} AS ts, '{freq}' AS frequency, '{method}' AS method, {cols}, {sums},
      min(min_tone) AS min_tone, max(max_tone) AS max_tone FROM {source} GROUP BY 1"""


_RESAMPLES = [("1h", "mean"), ("4h", "median"), ("1d", "first"), ("1d", "last"), ("1w", "mean")]


@query("resample", O.with_(BUCKETS) + " UNION ALL ".join(_resample_sql(f, m) for f, m in _RESAMPLES))
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = buckets(spark, sf_dir)
    out = None
    for freq, method in _RESAMPLES:
        part = _out(N.resample(base, freq, method), "ts").withColumns(
            {"frequency": F.lit(freq), "method": F.lit(method)})
        out = part if out is None else out.unionByName(part)
    return out


query("sentiment_daily", O.with_(_US) + f"SELECT ts, {_OUT} FROM ({_resample_sql('1d', 'mean')})")(
    lambda s, d: _out(N.resample(N.sentiment_15m(N.select_articles(X.articles(s, d), ["purchase", "click"])), "1d"), "ts"))

_EXACT = BUCKETS.replace("time_bucket(INTERVAL 15 MINUTE, ts) AS ts", "date_trunc('day', ts) AS ts")
query("resample_exact", O.with_(_EXACT) + f"SELECT ts, {_OUT} FROM b")(
    lambda s, d: _out(N.resample_exact(parsed(s, d), "1d"), "ts"))
query("resample_sketches")(lambda s, d: N.resample_sketches(N.source_sketches(parsed(s, d)), "1d"))

_GROUPED = O.PARSED + """, g AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, grp,
   sum(tone * coalesce(word_count, 1)) / nullif(sum(coalesce(word_count, 1)), 0) AS weighted_avg_tone, count(*) AS num_articles
  FROM (SELECT *, CASE WHEN contains(v2themes, 'PURCHASE') OR contains(v2themes, 'CLICK') THEN 'shop' ELSE 'other' END AS grp FROM parsed)
  GROUP BY 1, 2)"""


@query("topic_group_mean", O.with_(_GROUPED) + """SELECT ts, round(avg(weighted_avg_tone), 6) + 0.0 AS weighted_avg_tone,
   round(avg(num_articles), 6) AS num_articles FROM g GROUP BY ts""")
def topic_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = N.sentiment_15m(filters.topic_groups(parsed(spark, sf_dir), GROUPS), ["topic_group_id"])
    return N.topic_group_mean(grouped, ["weighted_avg_tone", "num_articles"]).select(
        "ts", F.round("weighted_avg_tone", 6).alias("weighted_avg_tone"), F.round("num_articles", 6).alias("num_articles"))


query("first_per_timestamp", O.with_(O.BARS) + """SELECT ts, arg_min(close, ticker) AS close,
   arg_min(volume, ticker) FILTER (volume > 100) AS volume FROM bars GROUP BY ts""")(
    lambda s, d: Q.first_per_timestamp(
        X.bars(s, d).withColumn("volume", F.when(F.col("volume") > 100, F.col("volume"))), ["close", "volume"]))

query("coverage", O.with_(O.SPARSE) + """SELECT ticker, frequency, n_rows, first_date, last_date, n_dates, span_days,
   round(bars_per_day, 6) AS bars_per_day, round(100 * bars_per_day, 6) AS expected_pct,
   CASE WHEN 100 * bars_per_day >= 99 THEN 'full' WHEN 100 * bars_per_day >= 80 THEN 'partial' ELSE 'low' END AS band,
   n_rows >= 100 AS enough_rows
 FROM (SELECT ticker, frequency, count(*) AS n_rows, min(dt) AS first_date, max(dt) AS last_date, count(DISTINCT dt) AS n_dates,
   date_diff('day', min(dt), max(dt)) + 1 AS span_days, count(*) / count(DISTINCT dt) AS bars_per_day FROM sparse_bars GROUP BY ticker, frequency)""")(
    lambda s, d: Q.coverage(X.sparse_bars(s, d)).withColumns(
        {n: F.round(n, 6) for n in ("bars_per_day", "expected_pct")}))

_PROFILED = ["sma_10", "sma_50", "sma_200", "volatility_20", "atr_14"]
_IND = f"""r AS (SELECT *, close / lag(close, 1) {W} - 1 AS returns,
  CASE WHEN lag(close, 1) {W} IS NOT NULL THEN greatest(high - low, abs(high - lag(close, 1) {W}), abs(low - lag(close, 1) {W})) END AS tr FROM bars),
 ind AS MATERIALIZED (SELECT ticker, dt, ts, close, returns, {O.guard('avg', 'close', 10)} AS sma_10, {O.guard('avg', 'close', 50)} AS sma_50,
  {O.guard('avg', 'close', 200)} AS sma_200, {O.guard('stddev_samp', 'returns', 20)} AS volatility_20, {O.guard('avg', 'tr', 14)} AS atr_14 FROM r)"""


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.indicator_set(X.bars(spark, sf_dir), ["returns", *_PROFILED])


query("null_coverage", O.with_(O.BARS, _IND) + """SELECT *, CASE WHEN pct >= 95 THEN 'good' WHEN pct >= 80 THEN 'fair'
   WHEN pct > 0 THEN 'low' ELSE 'none' END AS band FROM (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS indicator, count(*) AS total, count({n}) AS non_null, round(100.0 * count({n}) / count(*), 6) AS pct FROM ind"
    for n in _PROFILED) + ")")(
    lambda s, d: Q.null_coverage(_profiled(s, d), _PROFILED).withColumn("pct", F.round("pct", 6)))
query("quality_flags", O.with_(O.BARS, _IND) + """SELECT 'extreme_returns' AS rule, count(*) FILTER (abs(returns) > 1) AS n FROM ind
 UNION ALL SELECT 'negative_volatility_20', count(*) FILTER (volatility_20 < 0) FROM ind
 UNION ALL SELECT 'negative_atr_14', count(*) FILTER (atr_14 < 0) FROM ind
 UNION ALL SELECT 'nan', count(*) FILTER (isnan(sma_50)) FROM ind UNION ALL SELECT 'infinite', count(*) FILTER (isinf(sma_50)) FROM ind
 UNION ALL SELECT 'all_null', count(*) FILTER (coalesce(sma_50, volatility_20, atr_14) IS NULL) FROM ind""")(
    lambda s, d: Q.quality_flags(_profiled(s, d), ["volatility_20", "atr_14"], ["returns"], ["sma_50", "volatility_20", "atr_14"]))

query("range_stats", O.with_(BUCKETS) + """SELECT *, bad_tone + bad_polarity + zero_articles + zero_sources = 0 AS valid FROM (
 SELECT count(*) AS total_rows, count(*) FILTER (abs(weighted_avg_tone) > 10) AS bad_tone,
   count(*) FILTER (weighted_avg_polarity < 0) AS bad_polarity, count(*) FILTER (num_articles <= 0) AS zero_articles,
   count(*) FILTER (num_sources <= 0) AS zero_sources, count(*) FILTER (weighted_avg_tone IS NULL) AS null_tone,
   round(min(weighted_avg_tone), 6) AS min_tone, round(max(weighted_avg_tone), 6) AS max_tone, round(avg(weighted_avg_tone), 6) AS avg_tone,
   round(min(weighted_avg_polarity), 6) AS min_polarity, round(max(weighted_avg_polarity), 6) AS max_polarity FROM b)""")(
    lambda s, d: N.range_stats(buckets(s, d)).withColumns(
        {n: F.round(n, 6) for n in ("min_tone", "max_tone", "avg_tone", "min_polarity", "max_polarity")}))
query("duplicate_keys", O.with_(O.ARTICLES) + """SELECT source, dt, count(*) AS n FROM articles GROUP BY source, dt
 HAVING count(*) > 1 ORDER BY n DESC, source, dt LIMIT 10""")(
    lambda s, d: Q.duplicate_keys(X.articles(s, d), ["source", "dt"]))
query("weekday_share", O.with_(O.BARS) + """SELECT ticker, frequency, isodow(dt) - 1 AS weekday, dayname(dt) AS day_name,
   count(*) AS bars, count(DISTINCT dt) AS dates, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY ticker, frequency), 6) AS share_pct
 FROM bars GROUP BY ticker, frequency, isodow(dt), dayname(dt)""")(
    lambda s, d: Q.weekday_share(X.bars(s, d)).withColumn("share_pct", F.round("share_pct", 6)))
query("daily_summary", O.with_(BUCKETS) + """SELECT CAST(ts AS DATE) AS dt, count(*) AS intervals, CAST(sum(num_articles) AS BIGINT) AS articles,
   CAST(sum(total_word_count) AS BIGINT) AS words, round(avg(weighted_avg_tone), 6) AS avg_tone, min(min_tone) AS min_tone, max(max_tone) AS max_tone
 FROM b GROUP BY 1""")(lambda s, d: N.daily_summary(buckets(s, d)).withColumn("avg_tone", F.round("avg_tone", 6)))
_DAYS = """d AS (SELECT CAST(ts AS DATE) AS dt, round(avg(weighted_avg_tone), 9) AS t, CAST(sum(num_articles) AS BIGINT) AS articles FROM b GROUP BY 1)"""
query("extreme_days", O.with_(BUCKETS, _DAYS) + """SELECT dt, round(t, 6) AS avg_tone, articles, 'lowest' AS side FROM (SELECT * FROM d ORDER BY t, dt LIMIT 10)
 UNION ALL SELECT dt, round(t, 6), articles, 'highest' FROM (SELECT * FROM d ORDER BY t DESC, dt LIMIT 10)""")(
    lambda s, d: N.extreme_days(buckets(s, d)).withColumn("avg_tone", F.round(F.round("avg_tone", 9), 6)))
_THIN = "NOT (ticker = '5-LOW' AND year(dt) > 1997)"
query("limited_tickers", O.with_(O.SPARSE) + f"""SELECT ticker, n_days, round(avg_days, 6) AS avg_days FROM (SELECT ticker, n_days, avg(n_days) OVER () AS avg_days
 FROM (SELECT ticker, count(DISTINCT dt) AS n_days FROM sparse_bars WHERE {_THIN} GROUP BY ticker)) WHERE n_days < 0.9 * avg_days""")(
    lambda s, d: Q.limited_tickers(X.sparse_bars(s, d).where(_THIN)).withColumn("avg_days", F.round("avg_days", 6)))
query("indicator_profile", O.with_(O.BARS, _IND) + """SELECT ticker, count(*) AS total, count(sma_50) AS non_null,
   min(CASE WHEN sma_50 IS NOT NULL THEN dt END) AS first_date, max(CASE WHEN sma_50 IS NOT NULL THEN dt END) AS last_date,
   round(min(sma_50), 4) AS min_value, round(max(sma_50), 4) AS max_value, round(avg(sma_50), 4) AS avg_value,
   round(stddev_samp(sma_50), 4) AS std_value FROM ind GROUP BY ticker""")(
    lambda s, d: Q.indicator_profile(_profiled(s, d), "sma_50").withColumns(
        {n: F.round(n, 4) for n in ("min_value", "max_value", "avg_value", "std_value")}))


@query("freq_inventory", O.with_(O.BARS, O.ARTICLES) + """SELECT count(*) AS n_rows, min(ts) AS min_ts, max(ts) AS max_ts,
   string_agg(DISTINCT frequency, ',' ORDER BY frequency) AS frequencies
 FROM (SELECT ts, frequency FROM bars UNION ALL SELECT ts, '15m' FROM articles)""")
def freq_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.freq_inventory(X.bars(spark, sf_dir).select("ts", "frequency").unionByName(
        X.articles(spark, sf_dir).select("ts", F.lit("15m").alias("frequency"))))


_MEMBERS = "ticker IN ('AF', 'NF', 'RF')"
query("basket_mean", O.with_(O.BARS) + f"""SELECT ts, round(avg(close), 6) AS basket_close, count(close) AS members FROM bars
 WHERE {_MEMBERS} GROUP BY ts""")(
    lambda s, d: Q.basket_mean(X.bars(s, d), X.BASKET).withColumn("basket_close", F.round("basket_close", 6)))
_WT = "CASE ticker WHEN 'AF' THEN 0.5::DOUBLE WHEN 'NF' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END"
query("weighted_basket", O.with_(O.BARS) + f"""SELECT ts, round(sum(close * {_WT}) / sum({_WT}), 6) AS basket_close FROM bars
 WHERE {_MEMBERS} GROUP BY ts""")(
    lambda s, d: Q.weighted_basket(X.bars(s, d), X.BASKET_WEIGHTS).withColumn("basket_close", F.round("basket_close", 6)))
query("member_availability", O.with_(O.SPARSE) + """SELECT members, count(*) AS n_timestamps FROM (SELECT ts, count(close) AS members
 FROM sparse_bars WHERE ticker IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY ts) GROUP BY members""")(
    lambda s, d: Q.member_availability(X.sparse_bars(s, d), ["1-URGENT", "2-HIGH", "3-MEDIUM"]))

query("describe", O.with_(O.TRENDS) + """SELECT keyword, count(interest) AS n, round(avg(interest), 6) AS mean, round(stddev_samp(interest), 6) AS std,
   min(interest) AS min, quantile_cont(interest, 0.25) AS q25, quantile_cont(interest, 0.5) AS q50, quantile_cont(interest, 0.75) AS q75,
   max(interest) AS max, coalesce(stddev_samp(interest), 0) < 0.1 AS constant FROM trends GROUP BY keyword""")(
    lambda s, d: D.describe(X.trends_long(s, d), ["keyword"], "interest").withColumns(
        {n: F.round(n, 6) for n in ("mean", "std")}))
query("describe_bars", O.with_(O.BARS) + """SELECT ticker, count(close) AS n, round(avg(close), 4) AS mean, round(stddev_samp(close), 4) AS std,
   min(close) AS min, round(quantile_cont(close, 0.25), 4) AS q25, round(quantile_cont(close, 0.5), 4) AS q50, round(quantile_cont(close, 0.75), 4) AS q75,
   max(close) AS max, coalesce(stddev_samp(close), 0) < 0.1 AS constant FROM bars GROUP BY ticker""")(
    lambda s, d: D.describe(X.bars(s, d), ["ticker"], "close").withColumns(
        {n: F.round(n, 4) for n in ("mean", "std", "q25", "q50", "q75")}))


@query("fill_report", O.with_(O.SPARSE) + """, cal AS (SELECT ticker, unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS ts FROM sparse_bars GROUP BY ticker),
 f AS (SELECT c.ticker, c.ts, s.close, s.volume FROM cal c LEFT JOIN sparse_bars s ON s.ticker = c.ticker AND s.ts = c.ts),
 g AS (SELECT *, coalesce(close, last_value(close IGNORE NULLS) OVER p) AS fc, coalesce(volume, last_value(volume IGNORE NULLS) OVER p) AS fv
   FROM f WINDOW p AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING)) """ + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS total, count(*) - count({c}) AS missing_before, count({f}) - count({c}) AS filled,
     count(*) - count({f}) AS still_missing, round(100.0 * (count(*) - count({f})) / count(*), 6) AS still_missing_pct FROM g"""
    for c, f in (("close", "fc"), ("volume", "fv"))))
def fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = missing.regularise(X.sparse_bars(spark, sf_dir), ["ticker", "frequency"], "daily", ["close", "volume"])
    return missing.fill_report(spine, S.bars(), ["close", "volume"], 1).withColumn(
        "still_missing_pct", F.round("still_missing_pct", 6))


query("ohlc_bars", O.with_(O.TICKS) + """SELECT ticker, time_bucket(INTERVAL 1 HOUR, ts) AS bar_ts, arg_min(price, (ts, event_id)) AS open,
   max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, sum(volume) AS volume,
   round(sum(price * volume), 4) AS notional, count(*) AS transactions FROM ticks GROUP BY 1, 2""")(
    lambda s, d: Q.ohlc_bars(X.ticks(s, d), 3600).withColumn(
        "notional", F.round(F.coalesce(F.col("vwap") * F.col("volume"), F.lit(0.0)), 4)).drop("vwap"))

# --- gaps and islands --------------------------------------------------------

_GAPS = """g AS (SELECT ticker, frequency, lag(ts) OVER (PARTITION BY ticker ORDER BY ts) AS gap_start, ts AS gap_end FROM sparse_bars),
 h AS (SELECT *, date_diff('hour', gap_start, gap_end) AS gap_hours FROM g WHERE gap_start IS NOT NULL),
 k AS (SELECT *, isodow(gap_end) IN (1, 2) AND gap_hours BETWEEN 48 AND 120 AS weekend FROM h WHERE gap_hours >= 48)"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.date_gaps(X.sparse_bars(spark, sf_dir), S.bars(), 48)


query("date_gaps", O.with_(O.SPARSE, _GAPS) + """SELECT ticker, frequency, gap_start, gap_end, gap_hours, weekend FROM k
 ORDER BY gap_hours DESC, ticker, frequency, gap_start LIMIT 20""")(
    lambda s, d: Q.largest_gaps(_gaps(s, d), ["ticker", "frequency"], weekends=True))
query("weekend_gap_class", O.with_(O.SPARSE, _GAPS) + """SELECT ticker, frequency, gap_start, gap_end, gap_hours, weekend FROM k
 WHERE NOT weekend ORDER BY gap_hours DESC, ticker, frequency, gap_start LIMIT 20""")(
    lambda s, d: Q.largest_gaps(_gaps(s, d), ["ticker", "frequency"]))

_FULL = """cal AS (SELECT ticker, unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS ts FROM sparse_bars GROUP BY ticker),
 f AS MATERIALIZED (SELECT c.ticker, c.ts, CAST(c.ts AS DATE) AS dt, s.close, s.volume FROM cal c LEFT JOIN sparse_bars s ON s.ticker = c.ticker AND s.ts = c.ts)"""
_RUNS = """n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - row_number() OVER (PARTITION BY ticker, close IS NULL ORDER BY ts) AS grp FROM f),
 runs AS (SELECT ticker, min(dt) AS start_date, max(dt) AS end_date, count(*) AS length FROM n WHERE close IS NULL GROUP BY ticker, grp)"""
query("null_islands", O.with_(O.SPARSE, _FULL, _RUNS) + """SELECT ticker, start_date, end_date, length,
   date_diff('day', start_date, end_date) + 1 AS days FROM runs WHERE length >= 2""")(
    lambda s, d: Q.null_islands(missing.regularise(X.sparse_bars(s, d), ["ticker", "frequency"], "daily", ["close"])
                                .withColumn("dt", F.to_date("ts")), S.bars(), "close").drop("frequency"))
query("day_continuity", O.with_(O.SPARSE) + """SELECT ticker, prev AS after_date, dt AS next_date, date_diff('day', prev, dt) AS step_days
 FROM (SELECT ticker, dt, lag(dt) OVER (PARTITION BY ticker ORDER BY dt) AS prev FROM sparse_bars) WHERE date_diff('day', prev, dt) > 1""")(
    lambda s, d: Q.day_continuity(X.sparse_bars(s, d), ["ticker"]))
query("first_valid", O.with_(O.BARS, _IND) + " UNION ALL ".join(
    f"SELECT ticker, '{n}' AS indicator, min(CASE WHEN {n} IS NOT NULL THEN dt END) AS first_date FROM ind GROUP BY ticker" for n in _PROFILED))(
    lambda s, d: Q.first_valid(_profiled(s, d), _PROFILED))
query("sample_ends", O.with_(O.NUMBERED) + """SELECT ticker, dt, close, pos, CASE WHEN pos <= 10 AND pos > n - 10 THEN 'both'
   WHEN pos <= 10 THEN 'first' ELSE 'last' END AS side FROM (SELECT ticker, dt, close, rn AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM s)
 WHERE pos <= 10 OR pos > n - 10""")(
    lambda s, d: Q.sample_ends(X.bars(s, d), S.bars(), 10).select("ticker", "dt", "close", "pos", "side"))
query("missing_profile", O.with_(O.BARS, _IND) + """, h AS (SELECT * FROM ind ORDER BY ts, ticker LIMIT 50) """ + " UNION ALL ".join(
    f"""SELECT '{n}' AS column_name, (SELECT count(*) - count({n}) FROM ind) AS nulls, (SELECT count(*) - count({n}) FROM h) AS head_nulls,
     '{n.split('_')[0]}' AS family""" for n in _PROFILED))(
    lambda s, d: Q.missing_profile(_profiled(s, d), _PROFILED, ["ts", "ticker"]))
