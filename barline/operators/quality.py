"""Coverage, validity and gap reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import timeops
from barline.operators import series as S


def first_per_timestamp(df: DataFrame, names: Sequence[str], ts: str = "ts", order: str = "ticker") -> DataFrame:
    """First non-null value of each shared feature per timestamp, in ticker order."""
    return df.groupBy(ts).agg(*[
        F.min_by(n, F.when(F.col(n).isNotNull(), F.col(order))).alias(n) for n in names])


def coverage(df: DataFrame, min_rows: int = 100) -> DataFrame:
    """Rows, dates and bars per day of each series against what its frequency implies."""
    out = df.groupBy("ticker", "frequency").agg(
        F.count("*").alias("n_rows"), F.min("dt").alias("first_date"), F.max("dt").alias("last_date"),
        F.count_distinct("dt").alias("n_dates"))
    expected = timeops.bars_per_day(F.col("frequency"))
    out = out.withColumns({
        "span_days": (F.datediff("last_date", "first_date") + 1).cast("long"),
        "bars_per_day": F.try_divide(F.col("n_rows"), F.col("n_dates")),
    }).withColumn("expected_pct", F.try_divide(F.col("bars_per_day") * 100, expected))
    pct = F.col("expected_pct")
    return out.withColumns({
        "band": F.when(pct >= 99, "full").when(pct >= 80, "partial").otherwise("low"),
        "enough_rows": F.col("n_rows") >= min_rows})


def band(pct: Column) -> Column:
    return F.when(pct >= 95, "good").when(pct >= 80, "fair").when(pct > 0, "low").otherwise("none")


def _tall(one: DataFrame, parts: Sequence[str]) -> DataFrame:
    """One row of structs to one row per struct."""
    return one.select(F.inline(F.array(*[F.col(p) for p in parts])))


def null_coverage(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Non-null count and share of every column in a single pass."""
    total = F.count("*")
    one = df.agg(*[F.struct(F.lit(n).alias("indicator"), total.alias("total"), F.count(n).alias("non_null"),
                            (F.try_divide(F.count(n), total) * 100).alias("pct")).alias(n) for n in names])
    return _tall(one, names).withColumn("band", band(F.col("pct")))


def quality_flags(df: DataFrame, non_negative: Sequence[str], returns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rule violations as (rule, n): extreme returns, negative ranges, NaN, infinities, empty rows."""
    def any_of(tests: Sequence[Column]) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | F.coalesce(t, F.lit(False))
        return out

    rules: dict[str, Column] = {
        **{f"extreme_{n}": F.abs(F.col(n)) > 1 for n in returns},
        **{f"negative_{n}": F.col(n) < 0 for n in non_negative},
        "nan": any_of([F.isnan(F.col(n)) for n in names]),
        "infinite": any_of([F.abs(F.col(n)) == F.lit(float("inf")) for n in names]),
        "all_null": F.coalesce(*[F.col(n) for n in names]).isNull(),
    }
    one = df.agg(*[F.struct(F.lit(r).alias("rule"), F.count_if(c).alias("n")).alias(r) for r, c in rules.items()])
    return _tall(one, list(rules))


def duplicate_keys(df: DataFrame, keys: Sequence[str], top: int | None = 10) -> DataFrame:
    """Keys held by more than one row, most copies first."""
    found = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return found if top is None else found.orderBy(F.col("n").desc(), *keys).limit(top)


def weekday_share(df: DataFrame) -> DataFrame:
    """Bars, dates and percent share per weekday of every series."""
    days = df.groupBy("ticker", "frequency", F.weekday("dt").cast("long").alias("weekday")).agg(
        F.count("*").alias("bars"), F.count_distinct("dt").alias("dates"))
    total = days.groupBy("ticker", "frequency").agg(F.sum("bars").alias("__all"))
    names = F.element_at(F.array(*[F.lit(d) for d in (
        "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")]),
        (F.col("weekday") + 1).cast("int"))
    return days.join(total, ["ticker", "frequency"]).select(
        "ticker", "frequency", "weekday", names.alias("day_name"), "bars", "dates",
        F.try_divide(F.col("bars") * 100.0, F.col("__all")).alias("share_pct"))


def limited_tickers(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Tickers with fewer days than ``share`` of the average."""
    days = df.groupBy("ticker").agg(F.count_distinct("dt").alias("n_days"))
    average = days.agg(F.avg("n_days")).scalar()
    return days.withColumn("avg_days", average).where(F.col("n_days") < F.col("avg_days") * share)


def indicator_profile(df: DataFrame, name: str, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Counts, first and last date with a value, and value statistics of one column."""
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    c = F.col(name)
    dated = F.when(c.isNotNull(), F.col("dt"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count(c).alias("non_null"), F.min(dated).alias("first_date"),
        F.max(dated).alias("last_date"), F.min(c).alias("min_value"), F.max(c).alias("max_value"),
        F.avg(c).alias("avg_value"), F.stddev_samp(c).alias("std_value"))


def freq_inventory(df: DataFrame) -> DataFrame:
    """Rows, time range and the (few) distinct frequencies of a table."""
    return df.agg(F.count("*").alias("n_rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
                  F.array_join(F.array_sort(F.collect_set("frequency")), ",").alias("frequencies"))


def basket_mean(df: DataFrame, members: Sequence[str], column: str = "close") -> DataFrame:
    """Mean of the members' values per timestamp and how many contributed."""
    return df.where(F.col("ticker").isin(list(members))).groupBy("ts").agg(
        F.avg(column).alias("basket_close"), F.count(column).alias("members"))


def weighted_basket(df: DataFrame, weights: Mapping[str, float], column: str = "close") -> DataFrame:
    """Weighted mean over the members present; their weights are rescaled to one."""
    w = F.lit(None).cast("double")
    for ticker, value in weights.items():
        w = F.when(F.col("ticker") == ticker, F.lit(value)).otherwise(w)
    c = F.col(column)
    return df.where(F.col("ticker").isin(list(weights))).groupBy("ts").agg(
        F.try_divide(F.sum(c * w), F.sum(F.when(c.isNotNull(), w))).alias("basket_close"))


def member_availability(df: DataFrame, members: Sequence[str], column: str = "close") -> DataFrame:
    return basket_mean(df, members, column).groupBy("members").agg(F.count("*").alias("n_timestamps"))


def ohlc_bars(ticks: DataFrame, seconds: int, tie: str = "event_id") -> DataFrame:
    """OHLCV bars from ticks; open and close follow (ts, tie)."""
    at = F.struct("ts", tie)
    p, v = F.col("price"), F.col("volume")
    return ticks.groupBy("ticker", timeops.floor_to(F.col("ts"), seconds).alias("bar_ts")).agg(
        F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"),
        F.sum(v).alias("volume"), F.try_divide(F.sum(p * v), F.sum(v)).alias("vwap"), F.count("*").alias("transactions"))


def date_gaps(df: DataFrame, series: S.Series, min_hours: int) -> DataFrame:
    """Consecutive rows at least ``min_hours`` whole hours apart, weekend gaps marked.

    A gap of two to five days that ends on a Monday or Tuesday is a weekend or
    holiday closure.
    """
    stepped = S.over_blocks(df.select(*series.keys, "ts"), series,
                            [S.columns(gap_start=lambda w: F.lag("ts", 1).over(w))], before=1)
    hours = F.expr("timestampdiff(HOUR, gap_start, ts)")
    found = stepped.withColumn("gap_hours", hours).where(F.col("gap_hours") >= min_hours)
    weekend = F.weekday("gap_end").isin(0, 1) & F.col("gap_hours").between(48, 120)
    return (found.select(*series.keys, "gap_start", F.col("ts").alias("gap_end"), "gap_hours")
            .withColumn("weekend", weekend))


def largest_gaps(gaps: DataFrame, keys: Sequence[str], top: int | None = 20, weekends: bool = False) -> DataFrame:
    """Largest gaps; closures are removed before the limit is applied."""
    kept = gaps if weekends else gaps.where(~F.col("weekend"))
    ranked = kept.orderBy(F.col("gap_hours").desc(), *keys, "gap_start")
    return ranked if top is None else ranked.limit(top)


def null_islands(df: DataFrame, series: S.Series, column: str, min_length: int = 2) -> DataFrame:
    """Runs of NULLs: start, end, length and days spanned."""
    is_null = F.col(column).isNull()
    needed = df.select(*dict.fromkeys([*series.keys, *series.order, "dt", column]))
    numbered = S.with_position(needed, series, nulls=is_null.cast("long"))
    runs = numbered.where(is_null).groupBy(*series.keys, (F.col("pos") - F.col("nulls")).alias("__run")).agg(
        F.min("dt").alias("start_date"), F.max("dt").alias("end_date"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= min_length).drop("__run").withColumn(
        "days", (F.datediff("end_date", "start_date") + 1).cast("long"))


def day_continuity(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps longer than a day in a date series."""
    days = df.select(*keys, "dt").distinct()
    stepped = S.over_blocks(days, S.daily(keys), [S.columns(prev=lambda w: F.lag("dt", 1).over(w))], before=1)
    step = F.datediff("dt", "prev").cast("long")
    return stepped.withColumn("step_days", step).where(F.col("step_days") > 1).select(
        *keys, F.col("prev").alias("after_date"), F.col("dt").alias("next_date"), "step_days")


def first_valid(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """First date each column has a value, per key, in long form."""
    wide = df.groupBy(*keys).agg(*[F.min(F.when(F.col(n).isNotNull(), F.col("dt"))).alias(n) for n in names])
    return wide.unpivot(list(keys), list(names), "indicator", "first_date")


def sample_ends(df: DataFrame, series: S.Series, n: int) -> DataFrame:
    """First and last ``n`` rows of every series."""
    forward = S.with_position(df, series, "pos")
    sizes = df.groupBy(*series.keys).agg(F.count("*").alias("__n"))
    both = forward.join(sizes, list(series.keys))
    head, tail = F.col("pos") <= n, F.col("pos") > F.col("__n") - n
    return both.where(head | tail).withColumn(
        "side", F.when(head & tail, "both").when(head, "first").otherwise("last")).drop("__n")


def missing_profile(df: DataFrame, names: Sequence[str], order: Sequence[str], head: int = 50, worst: int | None = 20) -> DataFrame:
    """Nulls per column over the table and in its first rows, with the column's family."""
    first = df.orderBy(*order).limit(head).agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names])
    every = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names])
    a = every.unpivot([], list(names), "column_name", "nulls")
    b = first.unpivot([], list(names), "column_name", "head_nulls")
    family = F.regexp_extract("column_name", "^([a-z]+)", 1)
    ranked = (a.join(b, "column_name").withColumn("family", family)
              .orderBy(F.col("nulls").desc(), "column_name"))
    return ranked if worst is None else ranked.limit(worst)

