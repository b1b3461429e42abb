"""Joins between bars, indicators, sentiment and calendars (JN1-JN12).

No side is broadcast by hint unless its size is fixed by construction; the
optimizer and AQE choose from measured sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import timeops
from barline.operators import series as S

BAR_KEY = ["ticker", "ts", "frequency"]


def canonical_keys(df: DataFrame) -> DataFrame:
    """Frequency spelled canonically, so that ``daily`` and ``1d`` rows meet."""
    return df.withColumn("frequency", timeops.canonical_frequency(F.col("frequency")))


def join_bars_indicators(bars: DataFrame, indicators: DataFrame) -> DataFrame:
    return canonical_keys(bars).join(canonical_keys(indicators), BAR_KEY, "inner")


def join_shared(bars: DataFrame, shared: DataFrame, on: str = "ts") -> DataFrame:
    """Left join of a series shared by all tickers (sentiment, basket) on time."""
    return bars.join(shared, on, "left")


def alignment_counts(left: DataFrame, right: DataFrame, keys: Sequence[str] = tuple(BAR_KEY)) -> DataFrame:
    """How many keys are in both tables, only left, only right."""
    a = left.select(*keys, F.lit(True).alias("__l"))
    b = right.select(*keys, F.lit(True).alias("__r"))
    return a.join(b, list(keys), "full_outer").agg(
        F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("aligned"),
        F.count_if(F.col("__r").isNull()).alias("left_only"),
        F.count_if(F.col("__l").isNull()).alias("right_only"))


def raw_only(left: DataFrame, right: DataFrame, keys: Sequence[str] = tuple(BAR_KEY), top: int | None = 10) -> DataFrame:
    """Rows of ``left`` without a partner, earliest first."""
    rows = left.join(right.select(*keys), list(keys), "left_anti")
    return rows if top is None else rows.orderBy(*keys).limit(top)


def missing_keys(requested: DataFrame, data: DataFrame, keys: Sequence[str]) -> DataFrame:
    return requested.select(*keys).distinct().join(data.select(*keys), list(keys), "left_anti")


def calendar(df: DataFrame, keys: Sequence[str], frequency: str, ts: str = "ts") -> DataFrame:
    """Every slot between the first and last timestamp of each key."""
    bounds = df.groupBy(*keys).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    return timeops.calendar_spine(bounds, "__lo", "__hi", frequency, ts)


def expected_vs_actual(df: DataFrame, keys: Sequence[str], frequency: str, ts: str = "ts",
                       threshold: float = 95.0) -> DataFrame:
    """Expected and present slots per key and whether completeness passes."""
    slots = calendar(df, keys, frequency, ts)
    present = df.select(*keys, ts).distinct().withColumn("__here", F.lit(1))
    joined = slots.join(present, [*keys, ts], "left")
    return joined.groupBy(*keys).agg(
        F.count("*").alias("expected"), F.count("__here").alias("actual"),
    ).withColumns({
        "missing": F.col("expected") - F.col("actual"),
        "complete_pct": F.try_divide(F.col("actual") * 100.0, F.col("expected")),
    }).withColumn("passes", F.col("complete_pct") >= threshold)


def missing_intervals(df: DataFrame, keys: Sequence[str], frequency: str, ts: str = "ts") -> DataFrame:
    """Calendar slots of the requested frequency that hold no data."""
    slots = calendar(df, keys, frequency, ts)
    gone = slots.join(df.select(*keys, ts).distinct(), [*keys, ts], "left_anti")
    return gone.withColumns({"day_name": F.date_format(ts, "EEEE"), "hour": F.hour(ts).cast("long")})


def compare_versions(a: DataFrame, b: DataFrame, keys: Sequence[str], names: Sequence[str],
                     suffixes: tuple[str, str] = ("_computed", "_stored")) -> DataFrame:
    """Two versions of the same columns side by side."""
    left = a.select(*keys, *[F.col(n).alias(n + suffixes[0]) for n in names])
    right = b.select(*keys, *[F.col(n).alias(n + suffixes[1]) for n in names])
    return left.join(right, list(keys), "inner")


def combined_export(bars: DataFrame, indicators: DataFrame, names: Sequence[str], constants: Mapping[str, str]) -> DataFrame:
    """All bars with their stored indicators where there are any, plus constant columns."""
    joined = bars.join(indicators.select(*BAR_KEY, *names), BAR_KEY, "left")
    return joined.select(*BAR_KEY, *[c for c in bars.columns if c not in BAR_KEY], *names,
                         *[F.lit(v).alias(k) for k, v in constants.items()])


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], series: S.Series,
                  ts: str = "ts") -> DataFrame:
    """Latest ``right`` row at or before each ``left`` row, per key.

    Both sides are stacked in time order and the last right row is carried
    forward, so a hot key costs no more than a scan of its rows.
    """
    payload = F.struct(*[F.col(v).alias(v) for v in values], F.col(ts).alias("__at"))
    # Of several right rows at one time the largest values count, in any run.
    right = right.groupBy(*keys, ts).agg(F.max(F.struct(*values)).alias("__v")).select(*keys, ts, "__v.*")
    a = left.withColumns({"__side": F.lit(1), "__row": F.struct(*left.columns)}).select(*keys, ts, "__side", "__row")
    b = right.select(*keys, ts, F.lit(0).alias("__side"), payload.alias("__hit"))
    stacked = a.unionByName(b, allowMissingColumns=True)
    ordered = S.Series(tuple(keys), (ts, "__side"), series.block_rows, series.bucket)
    carried = S.running(stacked, ordered, lasts={"__last": F.col("__hit")})
    return carried.where(F.col("__side") == 1).select(
        "__row.*", *[F.col(f"__last.{v}").alias(f"{v}_asof") for v in values], F.col("__last.__at").alias("matched_ts"))


def parameter_grid(base: DataFrame, lists: Mapping[str, Sequence[object]], tied: Mapping[str, Column] | None = None,
                   order: Sequence[str] = (), first: int | None = None) -> DataFrame:
    """Every combination of parameter values for each row of ``base``, tied ones derived.

    A grid is unfolded from literal lists, so it is never a join.
    """
    grid = base
    for name, values in lists.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    if tied:
        grid = grid.withColumns(dict(tied))
    return grid if first is None else grid.orderBy(*order).limit(first)


def uniform(seed: int, *parts: str | Column) -> Column:
    """A number in [0, 1) from 48 bits of a digest of its parts: the same after a retry and in other engines."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def parameter_draws(base: DataFrame, keys: Sequence[str], n: int, log_ranges: Mapping[str, tuple[float, float]] | None = None,
                    ranges: Mapping[str, tuple[float, float]] | None = None, choices: Mapping[str, Sequence[object]] | None = None,
                    seed: int = 42) -> DataFrame:
    """``n`` random settings for each row of ``base`` (named by ``keys``), numbered by ``draw``.

    ``log_ranges`` gives two powers of ten to draw between evenly by magnitude, ``ranges`` two bounds, ``choices`` a list.
    A draw depends on seed, parameter, row and number only, so further draws or parameters leave earlier ones alone.
    """
    drawn = base.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n > 0 else base.withColumn("draw", F.lit(1)).limit(0)

    def at(name: str) -> Column:
        return uniform(seed, F.lit(name), *keys, "draw")

    values: dict[str, Column] = {}
    for name, (low, high) in (log_ranges or {}).items():
        values[name] = F.pow(F.lit(10.0), F.lit(float(low)) + at(name) * F.lit(float(high - low)))
    for name, (low, high) in (ranges or {}).items():
        values[name] = F.lit(float(low)) + at(name) * F.lit(float(high - low))
    for name, options in (choices or {}).items():
        values[name] = F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(at(name) * len(options)) + 1).cast("int"))
    return drawn.withColumns(values)
