"""Forecast evaluation over (sample, horizon, y, yhat) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators import describe as D
from barline.operators import series as S


def _error() -> Column:
    return F.col("y") - F.col("yhat")


def error_metrics() -> list[Column]:
    e = _error()
    return [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
            F.sqrt(F.avg(e * e)).alias("rmse")]


def mae_rmse(df: DataFrame) -> DataFrame:
    return df.agg(*error_metrics())


def per_horizon(df: DataFrame) -> DataFrame:
    return df.groupBy("horizon").agg(*error_metrics()).withColumn(
        "label", F.concat(F.lit("H"), F.col("horizon").cast("string")))


def direction_sign(df: DataFrame) -> DataFrame:
    """Percent of equal signs over all horizons; zero equals zero."""
    return df.agg((F.avg((F.signum("y") == F.signum("yhat")).cast("double")) * 100).alias("dir_acc"))


def first_horizon(df: DataFrame) -> DataFrame:
    return df.where(F.col("horizon") == df.agg(F.min("horizon")).scalar())


def direction_positive(df: DataFrame) -> DataFrame:
    """Share of the first horizon where both or neither are above zero."""
    same = (F.col("y") > 0) == (F.col("yhat") > 0)
    return first_horizon(df).agg(F.avg(same.cast("double")).alias("dir_acc"))


def direction_diff(df: DataFrame, series: S.Series) -> DataFrame:
    """First horizon, per series: share of steps in which both moved the same way."""
    steps = S.over_blocks(first_horizon(df), series, [S.columns(
        dy=lambda w: F.col("y") - F.lag("y", 1).over(w),
        dp=lambda w: F.col("yhat") - F.lag("yhat", 1).over(w))], before=1)
    return steps.groupBy(*series.keys).agg(
        F.try_divide(F.count_if(F.col("dy") * F.col("dp") > 0).cast("double"), F.count("*") - 1).alias("dir_acc"))


def mape(df: DataFrame) -> DataFrame:
    """Mean absolute percentage error; rows with y = 0 are left out."""
    return df.groupBy("horizon").agg((F.avg(F.try_divide(F.abs(_error()), F.abs("y"))) * 100).alias("mape"))


def quantile_loss(df: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Pinball loss of the forecast for every quantile level."""
    e = _error()
    parts = [F.struct(F.lit(q).alias("quantile"), F.avg(F.greatest(e * q, e * (q - 1))).alias("loss")).alias(f"q{i}")
             for i, q in enumerate(probs)]
    return df.groupBy("horizon").agg(*parts).select("horizon", F.inline(F.array(*[F.col(f"q{i}") for i in range(len(probs))])))


def interval_coverage(df: DataFrame, low: Column, high: Column) -> DataFrame:
    return df.groupBy("horizon").agg(
        F.count("*").alias("n"), F.avg(F.col("y").between(low, high).cast("double")).alias("coverage"),
        F.avg(high - low).alias("width"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean forecast against mean outcome in quantile bins of the forecast."""
    probs = [i / bins for i in range(1, bins)]
    edges = D.quantiles(df, ["horizon"], "yhat", probs, "disc")
    number = F.lit(1)
    for i in range(len(probs)):
        number = number + (F.col("yhat") > F.col(f"q{i}")).cast("int")
    return df.join(edges, "horizon").groupBy("horizon", number.cast("long").alias("bin")).agg(
        F.count("*").alias("n"), F.avg("yhat").alias("mean_forecast"), F.avg("y").alias("mean_outcome"))


def directional_loss(df: DataFrame, weight: float = 2.0) -> DataFrame:
    """Squared error, weighted more where the direction is wrong."""
    wrong = F.signum("y") != F.signum("yhat")
    return df.groupBy("horizon").agg(
        F.avg(F.pow(_error(), F.lit(2)) * F.when(wrong, weight).otherwise(1.0)).alias("loss"))


def batch_mean_loss(df: DataFrame, series: S.Series, batch: int) -> DataFrame:
    """Mean of per-batch mean squared errors next to the exact mean, per series."""
    e = _error()
    rows = S.with_position(df.withColumn("__sq", e * e), series)
    batches = rows.groupBy(*series.keys, F.floor((F.col("pos") - 1) / batch).alias("__batch")).agg(
        F.avg("__sq").alias("__mean"), F.sum("__sq").alias("__sum"), F.count("__sq").alias("__n"))
    return batches.groupBy(*series.keys).agg(
        F.count("*").alias("batches"), F.avg("__mean").alias("batch_mean"),
        F.try_divide(F.sum("__sum"), F.sum("__n")).alias("exact_mean"))


def persistence_forecasts(df: DataFrame, series: S.Series, price: str, horizons: Sequence[int]) -> DataFrame:
    """Zero-return and last-return forecasts in long form, for rows where both exist."""
    far = max(horizons)
    cols = {}
    for h in horizons:
        cols[f"__y{h}"] = lambda w, h=h: F.try_divide(F.lead(price, h).over(w) - F.col(price), F.col(price))
        cols[f"__p{h}"] = lambda w, h=h: F.try_divide(F.col(price) - F.lag(price, h).over(w), F.lag(price, h).over(w))
    rows = S.over_blocks(df, series, [S.columns(**cols)], before=far, after=far)
    tall = rows.select(*dict.fromkeys([*series.keys, *series.order]), "pos", F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"__y{h}").alias("y"), F.col(f"__p{h}").alias("last")) for h in horizons])))
    tall = tall.where(F.col("y").isNotNull() & F.col("last").isNotNull())
    both = F.inline(F.array(F.struct(F.lit("zero").alias("model"), F.lit(0.0).alias("yhat")),
                            F.struct(F.lit("last").alias("model"), F.col("last").alias("yhat"))))
    return tall.select(*[c for c in tall.columns if c != "last"], both)
