"""Technical indicators over bar series.

An indicator is a column recipe plus how many rows it looks back. Any subset is
resolved with its dependencies, and all windows are evaluated over the same
blocks. Exponential averages carry their state from block to block instead, so
that they are exact at any block size and across any gap.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from barline.operators import series as S
from barline.session import settle

# An exponential average forgets: after this many e-foldings the weight of older
# rows (1e-30) is far below the resolution of a double.
_FORGET = 69.0
_STEP_CAP = 100.0


@dataclass(frozen=True)
class Indicator:
    """``step`` adds column ``name``; ``before`` rows of history are enough for it."""

    name: str
    before: int
    expr: Callable[[WindowSpec], Column] | None = None
    step: S.Step | None = None
    ewm: "Ewm | None" = None
    needs: tuple[str, ...] = ()


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def change(column: str, k: int) -> Callable[[WindowSpec], Column]:
    """Relative change against the value ``k`` rows back."""
    return lambda w: _ratio(F.col(column), F.lag(column, k).over(w)) - 1


def log_change(column: str, k: int = 1) -> Callable[[WindowSpec], Column]:
    return lambda w: F.ln(_ratio(F.col(column), F.lag(column, k).over(w)))


def difference(column: str, k: int) -> Callable[[WindowSpec], Column]:
    return lambda w: F.col(column) - F.lag(column, k).over(w)


def rate(column: str, k: int) -> Callable[[WindowSpec], Column]:
    """Percent change against ``k`` rows back."""
    return lambda w: _ratio(F.col(column) - F.lag(column, k).over(w), F.lag(column, k).over(w)) * 100


def mean(column: str, n: int) -> Callable[[WindowSpec], Column]:
    return lambda w: S.full_window(F.avg, column, w, n)


def spread(column: str, n: int) -> Callable[[WindowSpec], Column]:
    """Sample standard deviation of a full window."""
    return lambda w: S.full_window(F.stddev_samp, column, w, n)


def zscore(column: str, n: int) -> Callable[[WindowSpec], Column]:
    return lambda w: _ratio(F.col(column) - S.full_window(F.avg, column, w, n),
                            S.full_window(F.stddev_samp, column, w, n))


def true_range(w: WindowSpec) -> Column:
    prev = F.lag("close", 1).over(w)
    high, low = F.col("high"), F.col("low")
    return F.when(prev.isNotNull() & high.isNotNull() & low.isNotNull(),
                  F.greatest(high - low, F.abs(high - prev), F.abs(low - prev)))


def ewm_history(alpha: float) -> int:
    """Rows of history after which an exponential average no longer changes."""
    return 1 if alpha >= 1 else math.ceil(_FORGET / -math.log1p(-alpha))


@dataclass(frozen=True)
class Ewm:
    """One exponential average of ``source``, NULL until it has seen ``min_periods`` values."""

    name: str
    source: str
    alpha: float
    min_periods: int

    @property
    def log_keep(self) -> float:
        return math.log1p(-self.alpha) if self.alpha < 1 else -_STEP_CAP


def _utc(table: pa.Table) -> pa.Table:
    """Times under the zone name that results are expected to have."""
    fields = [f.with_type(pa.timestamp("us", tz="UTC")) if pa.types.is_timestamp(f.type) and f.type.tz else f for f in table.schema]
    return table.cast(pa.schema(fields))


def exponential(rows: DataFrame, series: S.Series, averages: Sequence[Ewm]) -> DataFrame:
    """Add exponential averages, recursive form, decaying over NULL positions; ``rows`` are numbered by ``pos``.

    ``y = a * y_prev + b * x`` with ``a`` depending on the gap since the last value: a block of rows maps the state
    before it to the state after it by one affine function. Each block is averaged as if it were the first, along with
    how much of its first value is left in every row. What the blocks before it add is folded over the table of
    blocks (a ``block_rows``-th of the rows) and scaled by that share. Exact for any block size and any gap.
    """
    keys = list(series.keys)
    placed = rows.withColumn("__block", F.floor((F.col("pos") - 1) / F.lit(series.block_rows)))
    parts = [f"__{i}_{part}" for i in range(len(averages)) for part in ("local", "left", "count")]
    schema = StructType(placed.schema.fields + [
        StructField(n, LongType() if n.endswith("count") else DoubleType()) for n in parts])

    def local(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy())
        for i, e in enumerate(averages):
            x = table.column(e.source).cast(pa.float64()).to_numpy().astype(float)[order]
            seen = np.cumsum(~np.isnan(x))
            # The weight of the first value: 1 there, 0 in all later ones.
            start = np.where(np.isnan(x), np.nan, (seen == 1).astype(float))
            for name, values in (("local", x), ("left", start)):
                out = np.empty(len(x))
                out[order] = pd.Series(values).ewm(alpha=e.alpha, adjust=False).mean().to_numpy()
                table = table.append_column(f"__{i}_{name}", pa.array(out, pa.float64(), from_pandas=True))
            count = np.empty(len(x), np.int64)
            count[order] = seen
            table = table.append_column(f"__{i}_count", pa.array(count))
        return _utc(table)

    held = settle(placed.groupBy(*keys, "__block").applyInArrow(local, schema), "block-averages")

    def ends(i: int, e: Ewm) -> list[Column]:
        at = F.when(F.col(e.source).isNotNull(), F.col("pos"))
        return [F.max_by(f"__{i}_local", "pos").alias(f"local{i}"), F.max_by(f"__{i}_left", "pos").alias(f"left{i}"),
                F.max_by(f"__{i}_count", "pos").alias(f"count{i}"), F.min(at).alias(f"first{i}"),
                F.min_by(F.col(e.source).cast("double"), at).alias(f"value{i}"), F.max(at).alias(f"last{i}")]

    summary = held.groupBy(*keys, "__block").agg(*(c for i, e in enumerate(averages) for c in ends(i, e)))
    given = [f for f in summary.schema.fields if f.name in (*keys, "__block")]
    states = [f"__{i}_{part}" for i in range(len(averages)) for part in ("before", "shift", "seen")]

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("__block")
        columns: dict[str, list] = {n: [] for n in states}
        for i, e in enumerate(averages):
            state, at, seen = None, None, 0
            block = zip(*(table.column(f"{c}{i}").to_pylist() for c in ("local", "left", "count", "first", "value", "last")))
            for end, left, count, first, value, last in block:
                columns[f"__{i}_before"].append(state)
                columns[f"__{i}_seen"].append(seen)
                shift = 0.0
                if count and state is not None:
                    keep = math.exp(max((first - at) * e.log_keep, -700.0))
                    shift = (keep * state + e.alpha * value) / (keep + e.alpha) - value
                columns[f"__{i}_shift"].append(shift)
                if count:
                    state, at, seen = end + shift * left, last, seen + count
        out = table.select([f.name for f in given])
        for n in states:
            out = out.append_column(n, pa.array(columns[n], pa.int64() if n.endswith("seen") else pa.float64()))
        return _utc(out)

    folded = summary.groupBy(*keys).applyInArrow(fold, StructType(given + [
        StructField(n, LongType() if n.endswith("seen") else DoubleType()) for n in states]))
    folded = folded.withColumnsRenamed({c: f"__of_{c}" for c in (*keys, "__block")})
    met = held.join(folded, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*keys, "__block")])
    values = {}
    for i, e in enumerate(averages):
        y = F.when(F.col(f"__{i}_count") > 0, F.col(f"__{i}_local") + F.col(f"__{i}_shift") * F.col(f"__{i}_left")).otherwise(F.col(f"__{i}_before"))
        values[e.name] = F.when(F.col(f"__{i}_seen") + F.col(f"__{i}_count") >= max(e.min_periods, 1), y)
    return met.withColumns(values).select(*rows.columns, *values)


def gain(source: str) -> Callable[[WindowSpec], Column]:
    """Rise against the previous row; 0 for a fall."""
    return lambda w: F.greatest(difference(source, 1)(w), F.lit(0.0)) + difference(source, 1)(w) * 0


def loss(source: str) -> Callable[[WindowSpec], Column]:
    """Fall against the previous row; 0 for a rise."""
    return lambda w: F.greatest(-difference(source, 1)(w), F.lit(0.0)) + difference(source, 1)(w) * 0


def strength(up: str, down: str) -> Column:
    """Smoothed gains over smoothed gains plus losses, x 100; NULL without any movement."""
    return F.try_divide(F.col(up) * 100, F.col(up) + F.col(down))


def rsi_simple(source: str, n: int, name: str) -> S.Step:
    """Relative strength index smoothed with a plain rolling mean."""
    up, down = f"__{name}_up", f"__{name}_down"

    def index(df: DataFrame, blocks: S.Blocks) -> DataFrame:
        return df.withColumn(name, strength(f"{up}_s", f"{down}_s")).drop(up, down, f"{up}_s", f"{down}_s")

    return chain(S.columns(**{up: gain(source), down: loss(source)}),
                 S.columns(**{f"{up}_s": mean(up, n), f"{down}_s": mean(down, n)}), index)


def _span(n: int) -> float:
    return 2.0 / (n + 1)


def chain(*steps: S.Step) -> S.Step:
    def run(df: DataFrame, blocks: S.Blocks) -> DataFrame:
        for step in steps:
            df = step(df, blocks)
        return df
    return run


def _plain(name: str, before: int, expr: Callable[[WindowSpec], Column], *needs: str) -> Indicator:
    return Indicator(name, before, expr=expr, needs=needs)


def _ema(n: int) -> Indicator:
    return Indicator(f"ema_{n}", ewm_history(_span(n)),
                     ewm=Ewm(f"ema_{n}", "close", _span(n), n))


CATALOG: dict[str, Indicator] = {}


def register(indicator: Indicator) -> None:
    """Make a named indicator available to ``indicator_set``."""
    CATALOG[indicator.name] = indicator


def _defaults() -> Iterable[Indicator]:
    yield _plain("returns", 1, change("close", 1))
    yield _plain("returns_5", 5, change("close", 5))
    yield _plain("returns_21", 21, change("close", 21))
    yield _plain("log_returns", 1, log_change("close"))
    for k in (5, 21):
        yield _plain(f"log_returns_{k}", k, log_change("close", k))
    for n in (5, 10, 20, 21):
        yield _plain(f"volatility_{n}", n - 1, spread("returns", n), "returns")
    for k in (5, 10, 21):
        yield _plain(f"momentum_{k}", k, difference("close", k))
    for k in (5, 10):
        yield _plain(f"roc_{k}", k, rate("close", k))
    for n in (5, 10, 20):
        yield _plain(f"volume_ma_{n}", n - 1, mean("volume", n))
    yield _plain("volume_ratio", 0, lambda w: _ratio(F.col("volume"), F.col("volume_ma_10")), "volume_ma_10")
    yield _plain("true_range", 1, true_range)
    yield _plain("atr_14", 13, mean("true_range", 14), "true_range")
    yield _plain("high_low_ratio", 0, lambda w: _ratio(F.col("high") - F.col("low"), F.col("close")))
    yield _plain("bb_middle_20", 19, mean("close", 20))
    yield _plain("bb_std_20", 19, spread("close", 20))
    yield _plain("bb_upper_20", 0, lambda w: F.col("bb_middle_20") + F.col("bb_std_20") * 2,
                 "bb_middle_20", "bb_std_20")
    yield _plain("bb_lower_20", 0, lambda w: F.col("bb_middle_20") - F.col("bb_std_20") * 2,
                 "bb_middle_20", "bb_std_20")
    yield _plain("bb_width", 0, lambda w: _ratio(F.col("bb_upper_20") - F.col("bb_lower_20"), F.col("bb_middle_20")),
                 "bb_upper_20", "bb_lower_20", "bb_middle_20")
    for n in (5, 10, 20, 21, 50, 200):
        yield _plain(f"sma_{n}", n - 1, mean("close", n))
    for n in (5, 10, 12, 20, 21, 26, 50, 200):
        yield _ema(n)
    yield _plain("macd", 0, lambda w: F.col("ema_12") - F.col("ema_26"), "ema_12", "ema_26")
    yield Indicator("macd_signal", ewm_history(_span(9)), ewm=Ewm("macd_signal", "macd", _span(9), 9),
                    needs=("macd",))
    yield _plain("macd_hist", 0, lambda w: F.col("macd") - F.col("macd_signal"), "macd", "macd_signal")
    yield _plain("_gain", 1, gain("close"))
    yield _plain("_loss", 1, loss("close"))
    for side in ("gain", "loss"):
        yield Indicator(f"_{side}_14", ewm_history(1 / 14), ewm=Ewm(f"_{side}_14", f"_{side}", 1 / 14, 14), needs=(f"_{side}",))
    yield _plain("rsi_14", 0, lambda w: strength("_gain_14", "_loss_14"), "_gain_14", "_loss_14")
    yield Indicator("rsi_14_simple", 15, step=rsi_simple("close", 14, "rsi_14_simple"))


for _indicator in _defaults():
    register(_indicator)

# The stored indicator columns by group.
GROUPS = {
    "returns": ["returns", "returns_5", "log_returns"],
    "volatility": ["volatility_5", "volatility_10", "volatility_20"],
    "momentum": ["momentum_5", "momentum_10", "roc_5", "roc_10", "macd", "macd_signal", "macd_hist"],
    "volume": ["volume_ma_5", "volume_ma_10", "volume_ratio", "obv"],
    "range": ["atr_14", "high_low_ratio"],
    "bollinger": ["bb_upper_20", "bb_middle_20", "bb_lower_20", "bb_width"],
    "sma": ["sma_10", "sma_20", "sma_50", "sma_200"],
    "ema": ["ema_12", "ema_26"],
}
STORED = [name for names in GROUPS.values() for name in names]


def lookback(name: str) -> int:
    """Rows of history the indicator and everything it is built from need."""
    if name == "obv":
        return 1
    item = CATALOG[name]
    return item.before + max((lookback(n) for n in item.needs), default=0)


def _stages(names: Sequence[str]) -> list[list[Indicator]]:
    """What is asked for and needed, in order of need, by the number of exponential averages before it."""
    stage: dict[str, int] = {}

    def visit(name: str) -> int:
        if name not in stage:
            before = [visit(n) + (CATALOG[n].ewm is not None) for n in CATALOG[name].needs]
            stage[name] = max(before, default=0)
        return stage[name]

    for name in names:
        visit(name)
    return [[CATALOG[n] for n, at in stage.items() if at == k] for k in range(max(stage.values()) + 1)]


def _reach(item: Indicator, stage: Sequence[Indicator]) -> int:
    """Rows that the windows of a stage look back for an indicator."""
    own = [n for n in stage if n.name in item.needs]
    return item.before + max((_reach(n, stage) for n in own), default=0)


def _evaluate(rows: DataFrame, series: S.Series, stage: list[Indicator]) -> DataFrame:
    """The windows of a stage over blocks, then its exponential averages."""
    windowed = [i for i in stage if i.ewm is None]
    before = max((_reach(i, windowed) for i in windowed), default=0)
    if before:
        # Indicators of one depth share a projection.
        depth: dict[str, int] = {}
        for item in windowed:
            depth[item.name] = max((depth[n] + 1 for n in item.needs if n in depth), default=0)
        levels = [[i for i in windowed if depth[i.name] == k] for k in range(max(depth.values()) + 1)]
        steps = [s for level in levels for s in (
            S.columns(**{i.name: i.expr for i in level if i.expr is not None}), *(i.step for i in level if i.step is not None))]
        rows = S.over_blocks(rows, series, steps, before=before, numbered=True)
    else:
        for item in windowed:
            rows = rows.withColumn(item.name, item.expr(None))
    averages = [i.ewm for i in stage if i.ewm is not None]
    return exponential(rows, series, averages) if averages else rows


def _obv_flow() -> Column:
    """Signed volume of the row; the first row counts in full."""
    prev, close, volume = F.col("__prev"), F.col("close"), F.coalesce("volume", F.lit(0.0))
    return (F.when(F.col("pos") == 1, volume).when(F.isnan(prev), 0.0).when(close > prev, volume)
            .when(close < prev, -volume).otherwise(F.lit(0.0)))


def indicator_set(df: DataFrame, names: Sequence[str] = tuple(STORED), series: S.Series | None = None) -> DataFrame:
    """Add the requested indicators, with whatever they depend on, to bars.

    Row numbers and on-balance volume come from one shuffle of the rows, everything
    windowed from a second one, and exponential averages from one each time an
    average is built on another.
    """
    series = series or S.bars()
    # The previous close, NaN where that row had none (inputs hold NULL, never NaN).
    previous = F.coalesce("close", F.lit(float("nan")))
    windowed = [n for n in names if n != "obv"]
    rows = S.bucketed(df, series)
    rows = S.running(rows, series, sums={"pos": F.lit(1).cast("long")},
                     lasts={"__prev": previous} if "obv" in names else {}, before_row=("__prev",))
    if "obv" in names:
        rows = S.running(rows, series, sums={"obv": _obv_flow()})
    rows = rows.drop(S.BUCKET)
    for stage in _stages(windowed) if windowed else []:
        rows = _evaluate(rows, series, stage)
    return rows.select(*df.columns, *[n for n in names if n not in df.columns])


def groups_to_columns(groups: Sequence[str]) -> list[str]:
    return [name for group in groups for name in GROUPS[group]]


def series_features(
    df: DataFrame,
    series: S.Series,
    value: str,
    lags: Sequence[int] = (),
    averages: Sequence[int] = (),
    rates: Sequence[int] = (),
    zscores: Sequence[int] = (),
    change_volatility: Sequence[int] = (),
    rsi: int | None = None,
) -> DataFrame:
    """Lags, rolling means, rates of change, z-scores, volatility of changes and RSI
    of any single-valued series (search interest, sentiment)."""
    first: dict[str, Callable[[WindowSpec], Column]] = {
        **{f"lag_{k}": (lambda w, k=k: F.lag(value, k).over(w)) for k in lags},
        **{f"avg_{n}": mean(value, n) for n in averages},
        **{f"roc_{k}": change(value, k) for k in rates},
        **{f"zscore_{n}": zscore(value, n) for n in zscores},
    }
    steps = []
    if change_volatility:
        first["__change"] = difference(value, 1)
    if first:
        steps.append(S.columns(**first))
    if change_volatility:
        steps.append(S.columns(**{f"change_vol_{n}": spread("__change", n) for n in change_volatility}))
    before = max([1, *lags, *averages, *rates, *zscores, *(n + 1 for n in change_volatility)])
    if rsi:
        steps.append(S.columns(__gain=gain(value), __loss=loss(value)))
    rows = S.over_blocks(df, series, steps, before=before)
    if rsi:
        rows = exponential(rows, series, [Ewm(f"{n}_s", n, 1 / rsi, rsi) for n in ("__gain", "__loss")])
        rows = rows.withColumn(f"rsi_{rsi}", strength("__gain_s", "__loss_s")).drop("__gain", "__loss", "__gain_s", "__loss_s")
    return rows.drop("pos", "__change")


def long_to_wide(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(ticker, frequency, ts, name, value) rows to one column per indicator name."""
    return (df.groupBy("ticker", "frequency", "ts").pivot("name", list(names))
            .agg(F.first("value", ignorenulls=True)))
