"""Registered queries: pivots, ordering and training sets (P, L, U, Q, S11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions import numeric, timeops
from barline.operators import features as Q
from barline.operators import filters, indicators as I, quality, reshape as R, series as S
from barline.plans import oracle as O
from barline.plans.filter_queries import VERSIONS, two_versions
from barline.plans.join_queries import SHARED, shared_daily
from barline.plans.registry import query
from barline.session import settle, work_dir
from barline.sources import fixtures as X

W = "OVER (PARTITION BY ticker ORDER BY dt)"
HORIZONS = [7, 14]
LOOKBACK = 30
CALENDAR = S.daily(())


def _round(df: DataFrame, keys: list[str], names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(n, digits).alias(n) for n in names])


# --- ordering, sampling, sets, pivots ----------------------------------------

_MEM = list(X.BAR_TICKERS)
query("pivot_wide", O.with_(O.BARS) + "SELECT dt, " + ", ".join(
    f"max(CASE WHEN ticker = '{m}' THEN {c} END) AS {m}_{c}" for m in _MEM for c in ("close", "volume")) + " FROM bars GROUP BY dt")(
    lambda s, d: R.pivot_wide(X.bars(s, d), "dt", _MEM, ["close", "volume"]))
query("unpivot_long", O.with_(O.TRENDS) + "SELECT dt, keyword, interest FROM trends")(
    lambda s, d: R.unpivot_long(
        X.trends_long(s, d).groupBy("dt").pivot("keyword", ["click", "view", "signup", "purchase", "error"]).agg(F.max("interest")),
        ["dt"], ["click", "view", "signup", "purchase", "error"], "keyword", "interest").dropna())
query("order_by_multi", O.with_(O.BARS) + "SELECT ticker, dt, close FROM bars ORDER BY ticker, dt")(
    lambda s, d: R.sort_by(X.bars(s, d).select("ticker", "dt", "close"), "ticker", "dt"))
query("top_k", "SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")(
    lambda s, d: R.top_k(X.table(s, d, "events").select("event_id", "user_id", "value"), 20, F.col("value").desc(), F.col("event_id")))
_DIFFS = ["sma_10", "sma_20"]
query("top_k_per_group", O.with_(O.BARS, VERSIONS) + """SELECT indicator, ticker, dt, round(diff, 4) AS diff, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY diff DESC, ticker, dt) AS rank FROM (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS indicator, ticker, dt, abs({n}_computed - {n}_stored) AS diff FROM pair WHERE {n}_computed IS NOT NULL" for n in _DIFFS)
      + ")) WHERE rank <= 10")(
    lambda s, d: R.top_k_per_group(
        two_versions(s, d).withColumns({n: F.abs(F.col(f"{n}_computed") - F.col(f"{n}_stored")) for n in _DIFFS})
        .unpivot(["ticker", "dt"], _DIFFS, "indicator", "diff").where("diff IS NOT NULL"),
        ["indicator"], 10, F.col("diff").desc(), F.col("ticker"), F.col("dt"))
    .select("indicator", "ticker", "dt", F.round("diff", 4).alias("diff"), F.col("rank").cast("long").alias("rank")))
query("random_sample", """SELECT event_id AS article_id, CAST(user_id AS VARCHAR) AS source FROM events
 ORDER BY md5(concat_ws('|', '42', CAST(event_id AS VARCHAR))), event_id LIMIT 20""")(
    lambda s, d: R.random_sample(X.articles(s, d).select("article_id", "source"), ["article_id"], 20))
query("shuffle", O.with_(O.BARS) + """SELECT ticker, dt, close, transactions FROM bars
 ORDER BY md5(concat_ws('|', '42', ticker, CAST(dt AS VARCHAR))), ticker, dt""")(
    lambda s, d: R.shuffle(X.bars(s, d).select("ticker", "dt", "close", "transactions"), ["ticker", "dt"]))
_ENDS = "SELECT event_id, ts, value FROM events"
query("union_all", f"""SELECT * FROM ({_ENDS} ORDER BY ts, event_id LIMIT 50) UNION ALL SELECT * FROM ({_ENDS} ORDER BY ts DESC, event_id DESC LIMIT 50)""")(
    lambda s, d: (lambda e: R.concat([R.top_k(e, 50, F.col("ts"), F.col("event_id")),
                                      R.top_k(e, 50, F.col("ts").desc(), F.col("event_id").desc())]))(
        X.table(s, d, "events").select("event_id", "ts", "value")))
query("concat_chunks", O.with_(O.BARS, O.SPARSE) + """SELECT ticker, dt, round(close, 4) AS close, open FROM bars
 UNION ALL SELECT ticker, dt, round(close, 4), NULL FROM sparse_bars""")(
    lambda s, d: _round(R.concat([X.bars(s, d), X.sparse_bars(s, d)]), ["ticker", "dt", "open"], ["close"], 4))
query("distinct_keys", O.with_(O.BARS) + "SELECT DISTINCT ticker, year(dt) AS y FROM bars ORDER BY ticker, y")(
    lambda s, d: R.distinct_keys(X.bars(s, d).withColumn("y", F.year("dt").cast("long")), ["ticker", "y"]))

# --- the feature matrix ------------------------------------------------------

_MEMBER_FEATURES = ["close", "volume", "sma_50"]
_FILLED = Q.matrix_features(X.BAR_TICKERS, _MEMBER_FEATURES)
_SHARED_FEATURES = ["weighted_avg_tone", "num_articles"]
_LAGS = {f"sentiment_lag_{k}": ("weighted_avg_tone", k) for k in (1, 7)}
FEATURES = [*_FILLED, *_SHARED_FEATURES, *_LAGS, "month_sin", "is_weekend"]


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trading day for all tickers: prices, indicators, sentiment and the basket."""
    return Q.feature_matrix(X.bars(spark, sf_dir), _MEMBER_FEATURES, X.BASKET, "daily", X.BAR_TICKERS, shared_daily(spark, sf_dir),
                            _SHARED_FEATURES, ["num_articles"], _LAGS).select("ts", "dt", *FEATURES, "basket_close")


def _m(c: str) -> str:
    return f"coalesce({c}, last_value({c} IGNORE NULLS) OVER p) AS {c}"


MATRIX = SHARED + f""", k AS (SELECT *, {O.guard('avg', 'close', 50)} AS sma_50 FROM bars),
 wide AS (SELECT ts, avg(close) FILTER (ticker IN ('AF', 'NF', 'RF')) AS basket_close, """ + ", ".join(
    f"max(CASE WHEN ticker = '{m}' THEN {f} END) AS {f}_{m}" for f in _MEMBER_FEATURES for m in X.BAR_TICKERS) + f""" FROM k GROUP BY ts),
 j AS (SELECT w.*, s.weighted_avg_tone, ln(1.0 + s.num_articles) AS num_articles FROM wide w LEFT JOIN shared s ON s.ts = w.ts),
 filled AS (SELECT ts, CAST(ts AS DATE) AS dt, basket_close, {", ".join(_m(c) for c in _FILLED)}, weighted_avg_tone, num_articles,
   lag(weighted_avg_tone, 1) OVER q AS sentiment_lag_1, lag(weighted_avg_tone, 7) OVER q AS sentiment_lag_7,
   sin(2 * pi() * month(ts) / 12.0) AS month_sin, CAST(0 AS BIGINT) AS is_weekend
  FROM j WINDOW p AS (ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), q AS (ORDER BY ts)),
 m AS MATERIALIZED (SELECT * FROM filled WHERE isodow(ts) < 6)"""
_MX = O.with_(O.BARS, MATRIX)
_R = {f: f"round({f}, 6) + 0.0 AS {f}" for f in [*FEATURES, "basket_close"]}
_R["is_weekend"] = "is_weekend"


def _mat(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(n) if n == "is_weekend" else F.round(n, 6).alias(n) for n in names])


query("pivot_features", _MX + "SELECT dt, " + ", ".join(_R.values()) + " FROM m")(
    lambda s, d: _mat(matrix(s, d), ["dt"], [*FEATURES, "basket_close"]))

_TICKERS_15M, _FEATURES_15M = ("click", "error", "purchase", "signup", "view"), ["close", "volume", "sma_10"]
_FILLED_15M = Q.matrix_features(_TICKERS_15M, _FEATURES_15M)


@query("pivot_features_15m", O.with_(O.TICKS) + f""", b AS (SELECT ticker, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, arg_max(price, (ts, event_id)) AS close,
   sum(volume) AS volume FROM ticks GROUP BY 1, 2),
 k AS (SELECT *, {O.guard('avg', 'close', 10, 'PARTITION BY ticker ORDER BY ts')} AS sma_10 FROM b),
 wide AS (SELECT ts, avg(close) FILTER (ticker IN ('click', 'view')) AS basket_close, {", ".join(
     f"max(CASE WHEN ticker = '{m}' THEN {f} END) AS {f}_{m}" for f in _FEATURES_15M for m in _TICKERS_15M)} FROM k GROUP BY ts),
 f AS (SELECT ts, basket_close, {", ".join(_m(c) for c in _FILLED_15M)} FROM wide WINDOW p AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
 SELECT ts, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in [*_FILLED_15M, "basket_close"])}, round(sin(2 * pi() * hour(ts) / 24.0), 6) + 0.0 AS hour_sin
 FROM f WHERE isodow(ts) < 6""")
def pivot_features_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix over bars of 15 minutes, for the tickers that the table holds."""
    bars = quality.ohlc_bars(X.ticks(spark, sf_dir), 900).withColumnRenamed("bar_ts", "ts").withColumn("frequency", F.lit("15m"))
    out = Q.feature_matrix(bars, _FEATURES_15M, ("click", "view"), "15m", fill_rows=3)
    return _round(out, ["ts"], [*_FILLED_15M, "basket_close", "hour_sin"])


_T = [f"target_{h}" for h in HORIZONS]
_TARGETS = "t AS MATERIALIZED (SELECT *, " + ", ".join(
    f"(lead(basket_close, {h}) OVER o - basket_close) / basket_close AS target_{h}" for h in HORIZONS) + " FROM m WINDOW o AS (ORDER BY ts))"
_MT = O.with_(O.BARS, MATRIX, _TARGETS)


def with_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.forward_returns(settle(matrix(spark, sf_dir), "matrix"), CALENDAR, "basket_close", HORIZONS)


query("forward_returns", O.with_(O.BARS) + "SELECT ticker, dt, " + ", ".join(
    f"round((lead(close, {h}) {W} - close) / close, 6) AS target_{h}" for h in (7, 14, 28)) + " FROM bars")(
    lambda s, d: _round(Q.forward_returns(X.bars(s, d), S.bars(), "close", [7, 14, 28]), ["ticker", "dt"],
                        ["target_7", "target_14", "target_28"]))
_WT = {21: 0.5, 63: 0.3, 126: 0.2}
query("weighted_target", O.with_(O.BARS) + "SELECT ticker, dt, round(" + " + ".join(
    f"{w}::DOUBLE * (lead(close, {h}) {W} - close) / close" for h, w in _WT.items()) + ", 6) AS target, round(" + " + ".join(
    f"{w}::DOUBLE * ln(lead(close, {h}) {W} / close)" for h, w in _WT.items()) + ", 6) AS log_target FROM bars")(
    lambda s, d: (lambda df: _round(Q.weighted_target(Q.weighted_target(df, _WT), _WT, log=True, name="log_target"),
                                    ["ticker", "dt"], ["target", "log_target"]))(
        Q.forward_returns(X.bars(s, d), S.bars(), "close", list(_WT))))


def _digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Order-sensitive summary of the sequence arrays, comparable with plain SQL."""
    return df.select(*keys, F.size("x").cast("long").alias("n_rows"), F.size(F.col("x")[0]).cast("long").alias("n_features"),
                     F.col("x")[0][0].alias("first_close"), F.element_at("x", -1)[0].alias("last_close"),
                     F.round(F.aggregate("x", F.lit(0.0), lambda a, r: a + F.coalesce(r[1], F.lit(0.0))), 4).alias("sum_volume"))


def _sequence_sql(lookback: int) -> str:
    p = f"(PARTITION BY ticker ORDER BY dt ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING)"
    return f"""count(*) OVER {p} AS n_rows, CAST(2 AS BIGINT) AS n_features, first_value(close) OVER {p} AS first_close,
      last_value(close) OVER {p} AS last_close, round(sum(volume) OVER {p}, 4) AS sum_volume"""


query("sequences", O.with_(O.BARS) + f"""SELECT ticker, dt, n_rows, n_features, first_close, last_close, sum_volume, y0, y1 FROM (
 SELECT ticker, dt, {_sequence_sql(LOOKBACK)}, round((lead(close, 7) {W} - close) / close, 6) AS y0,
   round((lead(close, 14) {W} - close) / close, 6) AS y1 FROM bars) WHERE n_rows = {LOOKBACK} AND y1 IS NOT NULL""")(
    lambda s, d: (lambda df: _digest(df, ["ticker", "dt", F.round(F.col("y")[0], 6).alias("y0"), F.round(F.col("y")[1], 6).alias("y1")]))(
        Q.sequences(X.bars(s, d), S.bars(), ["close", "volume"], "close", LOOKBACK, HORIZONS)))
query("sequences_simple", O.with_(O.BARS) + f"""SELECT ticker, dt, n_rows, n_features, first_close, last_close, sum_volume, y FROM (
 SELECT ticker, dt, close AS y, row_number() {W} AS rn, {_sequence_sql(LOOKBACK)} FROM bars)
 WHERE n_rows = {LOOKBACK} AND (rn - {LOOKBACK} - 1) % 5 = 0""")(
    lambda s, d: _digest(Q.sequences_simple(X.bars(s, d), S.bars(), ["close", "volume"], "close", LOOKBACK, 5), ["ticker", "dt", "y"]))

_NUM = f"""n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS r, count(*) OVER () - {LOOKBACK + max(HORIZONS)} AS ns FROM t),
 z AS MATERIALIZED (SELECT *, CASE WHEN r - {LOOKBACK} BETWEEN 0 AND ns - 1 THEN CASE WHEN r - {LOOKBACK} + 1 <= floor(ns * 0.7::DOUBLE) THEN 'train'
    WHEN r - {LOOKBACK} + 1 <= floor(ns * 0.85::DOUBLE) THEN 'val' ELSE 'test' END END AS split,
   greatest(least(r + {LOOKBACK}, floor(ns * 0.7::DOUBLE) + {LOOKBACK} - 1) - greatest(r + 1, {LOOKBACK}) + 1, 0) AS weight FROM n)"""
_MZ = O.with_(O.BARS, MATRIX, _TARGETS, _NUM)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix with targets, splits and weights, written once: fitting, scaling and
    windowing all read it again."""
    rows = settle(matrix(spark, sf_dir), "matrix")
    targets = Q.forward_returns(rows, CALENDAR, "basket_close", HORIZONS, keep_position=True)
    total = rows.agg(F.count("*")).scalar()
    return settle(Q.number_samples(targets, CALENDAR, LOOKBACK, max(HORIZONS), total=total), "samples")


_SCALED = [f for f in FEATURES if f not in Q.TIME_FEATURES]
query("time_split", _MZ + "SELECT dt, split FROM z WHERE split IS NOT NULL")(
    lambda s, d: samples(s, d).where("split IS NOT NULL").select("dt", "split"))


query("date_split", O.with_(O.BARS) + """SELECT ticker, dt, CASE WHEN dt < DATE '1999-01-01' THEN 'train' WHEN dt < DATE '2000-06-01' THEN 'val'
  ELSE 'test' END AS split FROM bars""")(
    lambda s, d: Q.date_split(X.bars(s, d), "1999-01-01", "2000-06-01").select("ticker", "dt", "split"))


def _wmean(c: str) -> str:
    return f"sum({c} * weight) / sum(CASE WHEN {c} IS NOT NULL THEN weight END)"


_FIT = "fit AS (SELECT " + ", ".join(
    f"{_wmean(c)} AS mean_{c}, sqrt(greatest({_wmean(f'{c} * {c}')} - ({_wmean(c)}) ** 2, 0)) AS std_{c}" for c in _SCALED) + " FROM z WHERE weight > 0)"


@query("scaler_standard", _MZ + ", " + _FIT + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(mean_{c}, 4) AS mean, round(std_{c}, 4) AS std FROM fit" for c in _SCALED))
def scaler_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = Q.fit_standard(samples(spark, sf_dir), FEATURES, F.col("weight"))
    return _round(Q.scaler_table(fitted), ["feature"], ["mean", "std"], 4)


_TM_COLS = ["close_AF", "close_NO", "volume_NF", "volume_AO", "sma_50_RF", "weighted_avg_tone", "num_articles", "sentiment_lag_7"]


@query("training_matrix", _MZ + ", " + _FIT + " SELECT dt, split, " + ", ".join(
    f"round((z.{c} - fit.mean_{c}) / fit.std_{c}, 5) + 0.0 AS {c}" for c in _TM_COLS) + ", round(month_sin, 6) + 0.0 AS month_sin, "
       + ", ".join(f"round({t}, 6) + 0.0 AS {t}" for t in _T) + " FROM z, fit WHERE split IS NOT NULL")
def training_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    scaled = Q.apply_standard(rows, Q.fit_standard(rows, FEATURES, F.col("weight"))).where("split IS NOT NULL")
    return scaled.select("dt", "split", *[F.round(c, 5).alias(c) for c in _TM_COLS],
                         F.round("month_sin", 6).alias("month_sin"), *[F.round(t, 6).alias(t) for t in _T])


# --- scalers over bars -------------------------------------------------------

_TRAIN = "dt < DATE '2000-01-01'"
_BAR = "SELECT ticker, dt, "


def _bars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = X.bars(spark, sf_dir).select("ticker", "dt", "close", "volume")
    return rows, rows.where(_TRAIN)


def _scalar(agg: str, c: str) -> str:
    return f"(SELECT {agg}({c}) FROM bars WHERE {_TRAIN})"


query("scaler_standard_eps", O.with_(O.BARS) + _BAR + ", ".join(
    f"round(({c} - {_scalar('avg', c)}) / ({_scalar('stddev_pop', c)} + 1e-8), 6) + 0.0 AS {c}" for c in ("close", "volume")) + " FROM bars")(
    lambda s, d: _round(Q.scale_standard_eps(*_bars(s, d), ["close", "volume"]), ["ticker", "dt"], ["close", "volume"]))
query("scaler_minmax", O.with_(O.BARS) + _BAR + ", ".join(
    f"round(({c} - {_scalar('min', c)}) / ({_scalar('max', c)} - {_scalar('min', c)} + 1e-8), 6) + 0.0 AS {c}" for c in ("close", "volume")) + " FROM bars")(
    lambda s, d: _round(Q.scale_minmax(*_bars(s, d), ["close", "volume"], 1e-8), ["ticker", "dt"], ["close", "volume"]))
query("scaler_robust", O.with_(O.BARS) + f"""SELECT b.ticker, b.dt, round((b.close - q.q2) / nullif(q.q3 - q.q1, 0), 6) + 0.0 AS close FROM bars b
 JOIN (SELECT ticker, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.5) AS q2, quantile_cont(close, 0.75) AS q3 FROM bars WHERE {_TRAIN} GROUP BY ticker) q
 ON q.ticker = b.ticker""")(
    lambda s, d: _round(Q.scale_robust(*_bars(s, d), "close"), ["ticker", "dt"], ["close"]))

_TGT = f"""tg AS (SELECT avg(y) AS mean, stddev_pop(y) AS std FROM ({' UNION ALL '.join(f"SELECT {t} AS y FROM z WHERE split = 'train'" for t in _T)}))"""
query("target_scaler", _MZ + ", " + _TGT + " SELECT dt, split, " + ", ".join(
    f"round(({t} - mean) / std, 6) + 0.0 AS {t}" for t in _T) + " FROM z, tg WHERE split IS NOT NULL")(
    lambda s, d: (lambda rows: _round(Q.apply_target(rows, Q.fit_target(rows.where("split = 'train'"), _T), _T), ["dt", "split"], _T))(
        samples(s, d).where("split IS NOT NULL")))
query("inverse_transform", O.with_(O.BARS) + _BAR + "round(close, 3) AS close, round(volume, 3) AS volume FROM bars")(
    lambda s, d: (lambda rows, train: (lambda fit: _round(Q.inverse_standard(Q.apply_standard(rows, fit), fit), ["ticker", "dt"], ["close", "volume"], 3))(
        Q.fit_standard(train, ["close", "volume"])))(*_bars(s, d)))
query("nan_inf_guard", _MZ + " " + " UNION ALL ".join(
    f"SELECT split, '{c}' AS feature, count(*) FILTER (isnan({c})) AS n_nan, count(*) FILTER (isinf({c})) AS n_inf, count(*) - count({c}) AS n_null FROM z WHERE split IS NOT NULL GROUP BY split"
    for c in _SCALED))(
    lambda s, d: (lambda rows: Q.nan_inf_guard(Q.apply_standard(rows, Q.fit_standard(rows, FEATURES, F.col("weight"))).where("split IS NOT NULL"), _SCALED))(samples(s, d)))
query("raw_with_targets", _MT + "SELECT dt, " + ", ".join(_R[f] for f in [*FEATURES, "basket_close"]) + ", " + ", ".join(
    f"round({t}, 6) + 0.0 AS target_{t.split('_')[1]}periods_ahead" for t in _T) + ", CAST(hour(ts) AS BIGINT) AS hour, dayname(ts) AS day_name FROM t")(
    lambda s, d: _mat(with_targets(s, d).withColumns({"hour": F.hour("ts").cast("long"), "day_name": F.date_format("ts", "EEEE")})
                      .withColumnsRenamed({t: f"target_{t.split('_')[1]}periods_ahead" for t in _T}),
                      ["dt", "hour", "day_name"], [*FEATURES, "basket_close", *[f"target_{h}periods_ahead" for h in HORIZONS]]))

# --- selection and checks ----------------------------------------------------

_CORR = ["open", "high", "low", "close", "volume", "vwap", "transactions"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1:]]
query("drop_correlated", O.with_(O.BARS) + "SELECT feature, round(max(abs(c)), 6) AS max_abs_corr FROM (" + " UNION ALL ".join(
    f"SELECT '{b}' AS feature, corr({a}, {b}) AS c FROM bars" for a, b in _PAIRS) + ") GROUP BY feature HAVING max(abs(c)) > 0.8")(
    lambda s, d: _round(Q.correlated_features(X.bars(s, d), _CORR, 0.8), ["feature"], ["max_abs_corr"]))


def _greedy_sql(limit: float) -> str:
    """A feature stays unless it correlates highly with an earlier one that stays."""
    flags = [f"NOT ({' OR '.join(f'(k{i} AND abs(corr_{i}_{j}) > {limit})' for i in range(j)) or 'FALSE'}) AS k{j}" for j in range(len(_CORR))]
    corrs = [f"corr({_CORR[i]}, {_CORR[j]}) AS corr_{i}_{j}" for j in range(len(_CORR)) for i in range(j)]
    stays = " UNION ALL ".join(f"SELECT '{c}' AS feature, n FROM k WHERE k{j}" for j, c in enumerate(_CORR))
    return f"c AS (SELECT count(*) AS n, {', '.join(corrs)} FROM bars), k AS (SELECT n, {', '.join(flags)} FROM c) {stays}"


def _kept_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Q.drop_correlated(X.bars(spark, sf_dir).select(*_CORR), _CORR, 0.8)
    return kept.agg(*[F.count("*").alias(c) for c in kept.columns]).unpivot([], kept.columns, "feature", "n")


query("drop_correlated_greedy", O.with_(O.BARS, _greedy_sql(0.8)))(_kept_features)
_SEL = ["open", "high", "low", "close", "volume"]
_FWD = f"fw AS (SELECT *, (lead(close, 7) {W} - close) / close AS target_7 FROM bars)"


def _selectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(Q.forward_returns(X.bars(spark, sf_dir), S.bars(), "close", [7]), "selectable")


query("select_top_k", O.with_(O.BARS, _FWD) + "SELECT feature, round(r * r / (1 - r * r) * (n - 2), 3) AS f_score FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, target_7) AS r, count(target_7) AS n FROM fw" for c in _SEL) + ") ORDER BY r * r DESC LIMIT 3")(
    lambda s, d: Q.select_f_regression(_selectable(s, d), _SEL, "target_7", 3).select("feature", F.round("f_score", 3).alias("f_score")))
_P = [i / 10 for i in range(1, 10)]


def _bins(c: str, q: str) -> str:
    return " + ".join(f"CAST({c} > {q}[{i + 1}] AS INTEGER)" for i in range(9))


query("select_mutual_info", O.with_(O.BARS, _FWD) + """, k AS (SELECT * FROM fw WHERE target_7 IS NOT NULL), u AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS v, target_7 AS t FROM k" for c in _SEL) + f"""),
 qf AS (SELECT feature, quantile_disc(v, {_P}) AS q FROM u GROUP BY feature), qt AS (SELECT quantile_disc(target_7, {_P}) AS q FROM k),
 g AS (SELECT u.feature, {_bins('v', 'qf.q')} AS x, {_bins('t', 'qt.q')} AS y FROM u JOIN qf ON qf.feature = u.feature, qt),
 n AS (SELECT feature, x, y, count(*) AS n FROM g GROUP BY ALL),
 w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS na, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM n)
 SELECT feature, round(sum(n / na * ln(n * na / (nx * ny))), 6) AS mutual_info FROM w GROUP BY feature ORDER BY 2 DESC LIMIT 3""")(
    lambda s, d: _round(Q.select_mutual_info(_selectable(s, d), _SEL, "target_7", 3), ["feature"], ["mutual_info"]))
_LEAK = ["returns", "sma_10", "volatility_10", "obv"]
query("leakage_check", O.with_(O.BARS) + f"""SELECT n AS feature, (SELECT count(*) FROM bars WHERE {_TRAIN}) AS compared,
  CAST(0 AS BIGINT) AS leaks FROM (SELECT unnest({_LEAK}) AS n)""")(
    lambda s, d: Q.future_leaks(X.bars(s, d), lambda df: I.indicator_set(df, _LEAK), _LEAK, "2000-01-01", ["ticker", "ts"]))
query("leakage_found", O.with_(O.BARS) + f"""SELECT 'next_close' AS feature, (SELECT count(*) FROM bars WHERE {_TRAIN}) AS compared,
  count(*) AS leaks FROM (SELECT dt, lead(dt) {W} AS next_dt FROM bars) WHERE {_TRAIN} AND NOT next_{_TRAIN}""")(
    lambda s, d: Q.future_leaks(
        X.bars(s, d), lambda df: S.over_blocks(df, S.bars(), [S.columns(next_close=lambda w: F.lead("close", 1).over(w))], after=1),
        ["next_close"], "2000-01-01", ["ticker", "ts"]))
query("split_overlap", _MZ + """SELECT split, min(dt) AS first, max(dt) AS last, TRUE AS ordered FROM z WHERE split IS NOT NULL GROUP BY split""")(
    lambda s, d: Q.split_overlap(samples(s, d).where("split IS NOT NULL").select("dt", "split")))
query("min_samples_check", _MZ + """SELECT split, count(*) AS n, CAST(CASE split WHEN 'train' THEN 500 ELSE 100 END AS BIGINT) AS required,
  count(*) >= CASE split WHEN 'train' THEN 500 ELSE 100 END AS enough FROM z WHERE split IS NOT NULL GROUP BY split""")(
    lambda s, d: Q.min_samples_check(samples(s, d).where("split IS NOT NULL")))
_META = f"""SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test,
  count(*) AS n_samples, CAST({LOOKBACK} AS BIGINT) AS lookback, CAST({len(FEATURES)} AS BIGINT) AS n_features, CAST({len(HORIZONS)} AS BIGINT) AS n_horizons,
  '{",".join(FEATURES)}' AS features, '{",".join(map(str, HORIZONS))}' AS horizons FROM z WHERE split IS NOT NULL"""


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({"features": F.array_join("features", ","), "horizons": F.array_join("horizons", ",")})


query("dataset_metadata", _MZ + _META)(
    lambda s, d: _flat(Q.dataset_metadata(samples(s, d).where("split IS NOT NULL"), FEATURES, LOOKBACK, HORIZONS)))


@query("versioned_dataset", _MZ + _META.replace("SELECT count", "SELECT 'matrix/v1' AS dataset, count", 1))
def versioned_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled sequences written by split under a version, counted from what was written."""
    from barline.sources import writers

    rows = samples(spark, sf_dir)
    scaled = Q.apply_standard(rows, Q.fit_standard(rows, FEATURES, F.col("weight")))
    windows = Q.sequences(scaled, CALENDAR, FEATURES, "basket_close", LOOKBACK, HORIZONS)
    labelled = windows.join(rows.select("dt", "split"), "dt")
    return _flat(writers.write_dataset(spark, labelled, work_dir(spark, "datasets"), "matrix", "v1",
                                       FEATURES, LOOKBACK, HORIZONS))


@query("reload_dataset", _MZ + f"""SELECT dt, split, CAST({LOOKBACK} AS BIGINT) AS n_rows, round(lag(close_AF, 1) OVER o, 4) AS last_close_af,
   round(lag(volume_NO, {LOOKBACK}) OVER o, 4) AS first_volume_no FROM z WINDOW o AS (ORDER BY ts) QUALIFY split IS NOT NULL""")
def reload_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scaled dataset written, checked, read again and scaled back with the scaler beside it."""
    from barline.sources import writers

    rows = samples(spark, sf_dir)
    fitted = Q.fit_standard(rows, FEATURES, F.col("weight"))
    windows = Q.sequences(Q.apply_standard(rows, fitted), CALENDAR, FEATURES, "basket_close", LOOKBACK, HORIZONS)
    base = work_dir(spark, "datasets")
    writers.write_dataset(spark, windows.join(rows.select("dt", "split"), "dt"), base, "matrix", "v2", FEATURES, LOOKBACK, HORIZONS,
                          Q.scaler_table(fitted))
    sequences, scaler, manifest = writers.read_dataset(spark, f"{base}/matrix/v2")
    names = manifest.select("features").scalar()

    def back(row: Column, feature: str) -> Column:
        at = F.array_position(names, feature) - 1
        fit = scaler.where(F.col("feature") == feature)
        return F.round(F.get(row, at.cast("int")) * fit.select("std").scalar() + fit.select("mean").scalar(), 4)

    return sequences.select("dt", "split", F.size("x").cast("long").alias("n_rows"), back(F.element_at("x", -1), "close_AF").alias("last_close_af"),
                            back(F.col("x")[0], "volume_NO").alias("first_volume_no"))
