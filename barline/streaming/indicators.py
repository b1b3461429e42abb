"""Indicators on newly arrived bars only, from per-series state (ST7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW, SPAN = 10, 12
OUTPUT = "ticker string, ts timestamp, close double, sma_10 double, ema_12 double, obv double"


class BarIndicators(StatefulProcessor):
    """Keeps the last closes and the running values of one series.

    Bars of a micro-batch are taken in time order; a bar not newer than the last one seen is skipped, so a
    replayed file changes nothing. Missing closes are handled as in the batch form: an average over rows with one
    is missing, the exponential average decays over them, on-balance volume stays.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._closes = handle.getListState("closes", "close double")
        self._running = handle.getValueState("running", "seen long, gap long, ema double, obv double, last double, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        bars = pd.concat(list(rows)).sort_values("ts", kind="stable").drop_duplicates("ts")
        first = not self._running.exists()
        seen, gap, ema, obv, last, at = (0, 0, np.nan, 0.0, np.nan, 0) if first else self._running.get()
        stamp = bars["ts"].astype("datetime64[ns]").astype("int64")
        if not first:
            bars, stamp = bars[stamp > at], stamp[stamp > at]
        if bars.empty:
            return
        close = bars["close"].to_numpy(float)
        volume = bars["volume"].fillna(0.0).to_numpy(float)
        held = [c for (c,) in self._closes.get()] if self._closes.exists() else []
        closes = np.append(np.array(held, float), close)
        sma = pd.Series(closes).rolling(WINDOW).mean().to_numpy()[len(held):]
        # The last average stands for all history, at the distance it has.
        chain = pd.Series(np.concatenate([[ema], np.full(gap, np.nan), close]))
        averages = chain.ewm(span=SPAN, adjust=False).mean().to_numpy()[1 + gap:]
        known = ~np.isnan(close)
        counts = seen + np.cumsum(known)
        before = np.append(last, close[:-1])
        flow = np.where(close > before, volume, np.where(close < before, -volume, 0.0))
        if first:
            flow[0] = volume[0]
        totals = obv + np.cumsum(flow)
        places = np.flatnonzero(known)
        gap = len(close) - 1 - int(places[-1]) if len(places) else gap + len(close)
        self._closes.put([(float(c),) for c in closes[-(WINDOW - 1):]])
        self._running.update((int(counts[-1]), gap, float(averages[-1]), float(totals[-1]), float(close[-1]), int(stamp.iloc[-1])))
        yield pd.DataFrame({"ticker": key[0], "ts": bars["ts"], "close": close, "sma_10": sma,
                            "ema_12": np.where(counts >= SPAN, averages, np.nan), "obv": totals})

    def close(self) -> None:
        pass


def stream_indicators(bars: DataFrame) -> DataFrame:
    """(ticker, ts, close, volume) stream to bars with indicators."""
    return bars.groupBy("ticker").transformWithStateInPandas(
        statefulProcessor=BarIndicators(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
