"""Registered queries: technical indicators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators import indicators as I
from barline.operators import series as S
from barline.plans import oracle as O
from barline.plans.registry import query
from barline.sources import fixtures as X

W = "OVER (PARTITION BY ticker ORDER BY dt)"
KW = "PARTITION BY keyword ORDER BY dt"


def _rounded(df: DataFrame, keys: Sequence[str], names: Sequence[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(n, digits).alias(n) for n in names])


def _bar_query(key: str, names: Sequence[str], sql: dict[str, str], extra: str = "", digits: int = 6) -> None:
    body = ", ".join(f"round({sql[n]}, {digits}) AS {n}" for n in names)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(I.indicator_set(X.bars(spark, sf_dir), names), ["ticker", "dt"], names, digits)

    query(key, O.with_(O.BARS) + (extra or f"SELECT ticker, dt, {body} FROM bars"))(run)


_RET = f"close / lag(close, 1) {W} - 1"
_R_CTE = f"r AS (SELECT *, {_RET} AS returns FROM bars)"

_bar_query("returns", ["returns", "returns_5", "returns_21"], {
    "returns": _RET, "returns_5": f"close / lag(close, 5) {W} - 1", "returns_21": f"close / lag(close, 21) {W} - 1"})
_bar_query("log_returns", ["log_returns", "log_returns_5", "log_returns_21"], {
    "log_returns": f"ln(close / lag(close, 1) {W})", "log_returns_5": f"ln(close / lag(close, 5) {W})",
    "log_returns_21": f"ln(close / lag(close, 21) {W})"})
_vol = {f"volatility_{n}": O.guard("stddev_samp", "returns", n) for n in (5, 10, 20, 21)}
query("volatility", O.with_(O.BARS, _R_CTE) + "SELECT ticker, dt, "
      + ", ".join(f"round({e}, 6) AS {n}" for n, e in _vol.items()) + " FROM r")(
    lambda spark, sf: _rounded(I.indicator_set(X.bars(spark, sf), list(_vol)), ["ticker", "dt"], list(_vol)))
_bar_query("momentum", ["momentum_5", "momentum_10", "momentum_21"],
           {f"momentum_{k}": f"close - lag(close, {k}) {W}" for k in (5, 10, 21)})
_bar_query("roc", ["roc_5", "roc_10"],
           {f"roc_{k}": f"(close - lag(close, {k}) {W}) / lag(close, {k}) {W} * 100" for k in (5, 10)})
_bar_query("volume_ma", ["volume_ma_5", "volume_ma_10", "volume_ma_20"],
           {f"volume_ma_{n}": O.guard("avg", "volume", n) for n in (5, 10, 20)})
_bar_query("volume_ratio", ["volume_ratio"],
           {"volume_ratio": f"volume / nullif({O.guard('avg', 'volume', 10)}, 0)"})
_bar_query("high_low_ratio", ["high_low_ratio"], {"high_low_ratio": "(high - low) / nullif(close, 0)"})
_bar_query("sma", ["sma_10", "sma_20", "sma_50", "sma_200"],
           {f"sma_{n}": O.guard("avg", "close", n) for n in (10, 20, 50, 200)})
_mid, _std = O.guard("avg", "close", 20), O.guard("stddev_samp", "close", 20)
_bar_query("bollinger", I.GROUPS["bollinger"], {
    "bb_upper_20": f"({_mid}) + 2 * ({_std})", "bb_middle_20": _mid, "bb_lower_20": f"({_mid}) - 2 * ({_std})",
    "bb_width": f"((({_mid}) + 2 * ({_std})) - (({_mid}) - 2 * ({_std}))) / nullif({_mid}, 0)"})

_TR = f"""tr AS (SELECT *, CASE WHEN lag(close, 1) {W} IS NOT NULL THEN greatest(high - low,
  abs(high - lag(close, 1) {W}), abs(low - lag(close, 1) {W})) END AS tr FROM bars)"""
query("atr", O.with_(O.BARS, _TR) + f"SELECT ticker, dt, round({O.guard('avg', 'tr', 14)}, 6) AS atr_14 FROM tr")(
    lambda spark, sf: _rounded(I.indicator_set(X.bars(spark, sf), ["atr_14"]), ["ticker", "dt"], ["atr_14"]))

_FLOW = f"""flow AS (SELECT *, CASE WHEN lag(close, 1) {W} IS NULL THEN volume WHEN close > lag(close, 1) {W} THEN volume
  WHEN close < lag(close, 1) {W} THEN -volume ELSE 0 END AS flow FROM bars)"""
query("obv", O.with_(O.BARS, _FLOW) + f"SELECT ticker, dt, round(sum(flow) {W}, 6) + 0.0 AS obv FROM flow")(
    lambda spark, sf: _rounded(I.indicator_set(X.bars(spark, sf), ["obv"]), ["ticker", "dt"], ["obv"]))


def ewm_oracle() -> str:
    """One recursion carrying both averages and the signal line of their difference."""
    a12, a26, a9 = "(2.0::DOUBLE/13)", "(2.0::DOUBLE/27)", "(2.0::DOUBLE/10)"
    n12, n26 = f"((1-{a12})*e.e12 + {a12}*s.close)", f"((1-{a26})*e.e26 + {a26}*s.close)"
    return O.with_(O.NUMBERED, f"""e(ticker, dt, rn, e12, e26, sig) AS (
 SELECT ticker, dt, rn, close, close, CAST(NULL AS DOUBLE) FROM s WHERE rn = 1
 UNION ALL
 SELECT s.ticker, s.dt, s.rn, {n12}, {n26},
   CASE WHEN s.rn = 26 THEN {n12} - {n26} WHEN s.rn > 26 THEN (1-{a9})*e.sig + {a9}*({n12} - {n26}) END
 FROM e JOIN s ON s.ticker = e.ticker AND s.rn = e.rn + 1)""", recursive=True)


_E12, _E26 = "CASE WHEN rn >= 12 THEN e12 END", "CASE WHEN rn >= 26 THEN e26 END"
query("ema", ewm_oracle() + f"SELECT ticker, dt, round({_E12}, 4) AS ema_12, round({_E26}, 4) AS ema_26 FROM e")(
    lambda spark, sf: _rounded(I.indicator_set(X.bars(spark, sf), ["ema_12", "ema_26"]),
                               ["ticker", "dt"], ["ema_12", "ema_26"], 4))
query("ema_small_blocks", ewm_oracle() + f"SELECT ticker, dt, round({_E12}, 4) AS ema_12, round({_E26}, 4) AS ema_26 FROM e")(
    lambda spark, sf: _rounded(I.indicator_set(X.bars(spark, sf), ["ema_12", "ema_26"], S.bars(100)),
                               ["ticker", "dt"], ["ema_12", "ema_26"], 4))
_MACD = ["macd", "macd_signal", "macd_hist"]
query("macd", ewm_oracle() + f"""SELECT ticker, dt, round(CASE WHEN rn >= 26 THEN e12 - e26 END, 4) AS macd,
  round(CASE WHEN rn >= 34 THEN sig END, 4) AS macd_signal,
  round(CASE WHEN rn >= 34 THEN e12 - e26 - sig END, 4) AS macd_hist FROM e""")(
    lambda spark, sf: _rounded(I.indicator_set(X.bars(spark, sf), _MACD), ["ticker", "dt"], _MACD, 4))

_RSI = O.with_(O.NUMBERED, """d AS MATERIALIZED (SELECT ticker, dt, rn, greatest(close - lag(close) OVER p, 0) AS up,
   greatest(lag(close) OVER p - close, 0) AS down FROM s WINDOW p AS (PARTITION BY ticker ORDER BY dt)),
 e(ticker, dt, rn, g, l) AS (
 SELECT ticker, dt, rn, up, down FROM d WHERE rn = 2
 UNION ALL
 SELECT d.ticker, d.dt, d.rn, (13.0::DOUBLE/14)*e.g + d.up/14, (13.0::DOUBLE/14)*e.l + d.down/14
 FROM e JOIN d ON d.ticker = e.ticker AND d.rn = e.rn + 1)""", recursive=True)
_SIMPLE = f"SELECT ticker, dt, rn, {O.guard('avg', 'up', 14)} AS g, {O.guard('avg', 'down', 14)} AS l FROM d WHERE rn > 1"
query("rsi", _RSI + f"""SELECT d.ticker, d.dt,
  round(CASE WHEN d.rn >= 15 THEN 100 * e.g / nullif(e.g + e.l, 0) END, 6) AS rsi_14,
  round(100 * p.g / nullif(p.g + p.l, 0), 6) AS rsi_14_simple
 FROM d LEFT JOIN e ON e.ticker = d.ticker AND e.rn = d.rn LEFT JOIN ({_SIMPLE}) p ON p.ticker = d.ticker AND p.rn = d.rn""")(
    lambda spark, sf: _rounded(I.indicator_set(X.bars(spark, sf), ["rsi_14", "rsi_14_simple"]),
                               ["ticker", "dt"], ["rsi_14", "rsi_14_simple"]))

_SET = ["returns", "volatility_20", "sma_50", "volume_ratio", "bb_width", "atr_14", "obv"]
query("indicator_set", O.with_(O.BARS, f"""f AS (SELECT *, {_RET} AS returns,
  CASE WHEN lag(close, 1) {W} IS NOT NULL THEN greatest(high - low, abs(high - lag(close, 1) {W}), abs(low - lag(close, 1) {W})) END AS tr,
  CASE WHEN lag(close, 1) {W} IS NULL THEN volume WHEN close > lag(close, 1) {W} THEN volume
    WHEN close < lag(close, 1) {W} THEN -volume ELSE 0 END AS flow FROM bars)""") + f"""SELECT ticker, dt,
  round(returns, 6) AS returns, round({O.guard('stddev_samp', 'returns', 20)}, 6) AS volatility_20,
  round({O.guard('avg', 'close', 50)}, 6) AS sma_50, round(volume / nullif({O.guard('avg', 'volume', 10)}, 0), 6) AS volume_ratio,
  round(4 * ({_std}) / nullif({_mid}, 0), 6) AS bb_width, round({O.guard('avg', 'tr', 14)}, 6) AS atr_14,
  round(sum(flow) {W}, 6) + 0.0 AS obv FROM f""")(
    lambda spark, sf: _rounded(I.indicator_set(X.bars(spark, sf), _SET), ["ticker", "dt"], _SET))

query("indicator_core", O.with_(O.BARS, _R_CTE) + f"""SELECT ticker, dt,
  round({O.guard('stddev_samp', 'returns', 20)}, 6) AS volatility_20, round({O.guard('avg', 'close', 50)}, 6) AS sma_50 FROM r""")(
    lambda spark, sf: _rounded(I.indicator_set(X.bars(spark, sf), ["volatility_20", "sma_50"]),
                               ["ticker", "dt"], ["volatility_20", "sma_50"]))


def _trend_query(key: str, options: dict, sql: dict[str, str], cte: str = "") -> None:
    names = list(sql)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = I.series_features(X.trends_long(spark, sf_dir), S.daily(["keyword"]), "interest", **options)
        return _rounded(out, ["keyword", "dt"], names)

    source = "c" if cte else "trends"
    ctes = (O.TRENDS, cte) if cte else (O.TRENDS,)
    query(key, O.with_(*ctes) + "SELECT keyword, dt, "
          + ", ".join(f"round({e}, 6) AS {n}" for n, e in sql.items()) + f" FROM {source}")(run)


_tw = f"OVER ({KW})"
_trend_query("rolling_zscore", {"zscores": [21]}, {
    "zscore_21": f"(interest - {O.guard('avg', 'interest', 21, KW)}) / nullif({O.guard('stddev_samp', 'interest', 21, KW)}, 0)"})
_trend_query("rate_of_change", {"rates": [7, 14, 21]},
             {f"roc_{k}": f"interest / nullif(lag(interest, {k}) {_tw}, 0) - 1" for k in (7, 14, 21)})
_trend_query("rolling_average", {"averages": [5, 7, 10, 14, 21]},
             {f"avg_{n}": O.guard("avg", "interest", n, KW) for n in (5, 7, 10, 14, 21)})
_trend_query("change_volatility", {"change_volatility": [7, 14, 21]},
             {f"change_vol_{n}": O.guard("stddev_samp", "chg", n, KW) for n in (7, 14, 21)},
             f"c AS (SELECT *, interest - lag(interest) {_tw} AS chg FROM trends)")
_trend_query("lag_features", {"lags": [1, 5, 7, 10, 14, 21]},
             {f"lag_{k}": f"lag(interest, {k}) {_tw}" for k in (1, 5, 7, 10, 14, 21)})

_LONG = ["sma_10", "sma_20", "momentum_5"]


@query("indicators_long_to_wide", O.with_(O.BARS) + f"""SELECT ticker, frequency, ts,
  round({O.guard('avg', 'close', 10)}, 6) AS sma_10, round({O.guard('avg', 'close', 20)}, 6) AS sma_20,
  round(close - lag(close, 5) {W}, 6) AS momentum_5 FROM bars""")
def indicators_long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = I.indicator_set(X.bars(spark, sf_dir), _LONG)
    tall = wide.unpivot(["ticker", "frequency", "ts"], _LONG, "name", "value")
    return _rounded(I.long_to_wide(tall, _LONG), ["ticker", "frequency", "ts"], _LONG)

_TREND_RSI = O.with_(O.TRENDS, """s AS MATERIALIZED (SELECT keyword, dt, interest, row_number() OVER (PARTITION BY keyword ORDER BY dt) AS rn FROM trends),
 d AS MATERIALIZED (SELECT keyword, dt, rn, interest, lag(interest, 7) OVER p AS before, greatest(interest - lag(interest) OVER p, 0) AS up,
   greatest(lag(interest) OVER p - interest, 0) AS down FROM s WINDOW p AS (PARTITION BY keyword ORDER BY dt)),
 e(keyword, rn, g, l) AS (SELECT keyword, rn, up, down FROM d WHERE rn = 2
 UNION ALL SELECT d.keyword, d.rn, (13.0::DOUBLE/14)*e.g + d.up/14, (13.0::DOUBLE/14)*e.l + d.down/14
 FROM e JOIN d ON d.keyword = e.keyword AND d.rn = e.rn + 1)""", recursive=True)
query("trend_rsi", _TREND_RSI + """SELECT d.keyword, d.dt, round(CASE WHEN d.rn >= 15 THEN 100 * g / nullif(g + l, 0) END, 6) AS rsi_14,
  round(interest / nullif(before, 0) - 1, 6) AS roc_7 FROM d LEFT JOIN e ON e.keyword = d.keyword AND e.rn = d.rn""")(
    lambda spark, sf: _rounded(I.series_features(X.trends_long(spark, sf), S.daily(("keyword",)), "interest", rates=[7], rsi=14),
                               ["keyword", "dt"], ["rsi_14", "roc_7"]))
