"""Missing data: fills, imputation, interpolation, regular calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators import joins as J
from barline.operators import series as S


def ffill_limit(df: DataFrame, series: S.Series, names: Sequence[str], limit: int = 5) -> DataFrame:
    """Forward fill, at most ``limit`` rows after the last value of the same series."""
    fill = {n: (lambda w, n=n: F.coalesce(n, F.last(n, True).over(w.rowsBetween(-limit, -1)))) for n in names}
    return S.over_blocks(df, series, [S.columns(**fill)], before=limit).select(*df.columns)


def ffill(df: DataFrame, series: S.Series, names: Sequence[str]) -> DataFrame:
    return S.running(df, series, lasts={n: F.col(n) for n in names}).select(*df.columns)


def bfill(df: DataFrame, series: S.Series, names: Sequence[str]) -> DataFrame:
    """Backward fill. Uses later values, so it leaks the future; never a default."""
    return S.running(df, series, nexts={n: F.col(n) for n in names}).select(*df.columns)


def mean_impute(df: DataFrame, train: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fill with the means of the training rows only."""
    means = train.agg(F.struct(*[F.avg(n).alias(n) for n in names])).scalar()
    return df.withColumn("__m", means).withColumns(
        {n: F.coalesce(F.col(n), F.col("__m")[n]) for n in names}).drop("__m")


def interpolate(df: DataFrame, series: S.Series, name: str, ts: str = "ts") -> DataFrame:
    """Linear in time between the neighbouring known values; ends stay missing."""
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    known = F.when(F.col(name).isNotNull(), F.struct(at.alias("t"), F.col(name).alias("v")))
    both = S.running(df, series, lasts={"__prev": known}, nexts={"__next": known})
    t0, v0, t1, v1 = (F.col(c) for c in ("__prev.t", "__prev.v", "__next.t", "__next.v"))
    line = v0 + (v1 - v0) * F.try_divide(at - t0, t1 - t0)
    return both.withColumn(name, F.coalesce(F.col(name), line)).select(*df.columns)


def max_gap_drop(df: DataFrame, series: S.Series, name: str, max_gap: int = 5) -> DataFrame:
    """Drop the rows of missing runs longer than ``max_gap``.

    A row is in such a run if some stretch of ``max_gap + 1`` missing rows covers it:
    two windows of bounded reach, with no need to know how long the run is.
    """
    missing = F.count_if(F.col(name).isNull())
    steps = [
        S.columns(__full=lambda w: missing.over(w.rowsBetween(-max_gap, 0)) == max_gap + 1),
        S.columns(__long=lambda w: F.bool_or("__full").over(w.rowsBetween(0, max_gap))),
    ]
    out = S.over_blocks(df, series, steps, before=max_gap, after=max_gap)
    return out.where(F.col(name).isNotNull() | ~F.col("__long")).select(*df.columns)


def drop_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(names))


def regularise(df: DataFrame, keys: Sequence[str], frequency: str, names: Sequence[str], ts: str = "ts") -> DataFrame:
    """Complete each series to every slot of its calendar; new rows are empty."""
    spine = J.calendar(df, keys, frequency, ts)
    return spine.join(df.select(*keys, ts, *names), [*keys, ts], "left")


def fill_report(df: DataFrame, series: S.Series, names: Sequence[str], limit: int = 5) -> DataFrame:
    """Per column: missing before, filled by a limited forward fill, still missing."""
    frame = {f"__f_{n}": (lambda w, n=n: F.coalesce(n, F.last(n, True).over(w.rowsBetween(-limit, -1)))) for n in names}
    filled = S.over_blocks(df, series, [S.columns(**frame)], before=limit)
    total = F.count("*")
    one = filled.agg(*[F.struct(
        F.lit(n).alias("column_name"), total.alias("total"), (total - F.count(n)).alias("missing_before"),
        (F.count(f"__f_{n}") - F.count(n)).alias("filled"), (total - F.count(f"__f_{n}")).alias("still_missing"),
        (F.try_divide(total - F.count(f"__f_{n}"), total) * 100).alias("still_missing_pct")).alias(n) for n in names])
    return one.select(F.inline(F.array(*[F.col(n) for n in names])))
