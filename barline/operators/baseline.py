"""Linear and tree yardstick models and parameter searches with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators import evaluate as E


def flatten_windows(samples: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Lookback arrays as one ML vector per sample, targets as ``target_{h}``."""
    from pyspark.ml.functions import array_to_vector

    flat = samples.withColumn("features", array_to_vector(F.flatten("x")))
    return flat.withColumns({f"target_{h}": F.col("y")[i] for i, h in enumerate(horizons)})


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


MODELS = {"linear": LinearRegression, "tree": DecisionTreeRegressor, "boosted": GBTRegressor}
SETTINGS = {"linear": {"regParam": 0.1}, "tree": {"maxDepth": 5, "seed": 42}, "boosted": {"maxDepth": 3, "maxIter": 10, "seed": 42}}


def fit_score(df: DataFrame, horizons: Sequence[int], model: str = "linear", **settings) -> DataFrame:
    """Fit one model per horizon on the training split and score every split.

    ``model`` is ``linear``, ``tree`` (binned splits, grown level by level over all rows at once) or ``boosted``;
    ``settings`` go to the Spark ML estimator.
    """
    scored = None
    for h in horizons:
        ready = df.where(F.col(f"target_{h}").isNotNull())
        estimator = MODELS[model](featuresCol="features", labelCol=f"target_{h}", predictionCol="yhat", **{**SETTINGS[model], **settings})
        part = estimator.fit(ready.where(F.col("split") == "train")).transform(ready).withColumn("y", F.col(f"target_{h}")).groupBy("split").agg(
            *E.error_metrics()).withColumn("horizon", F.lit(h))
        scored = part if scored is None else scored.unionByName(part)
    return scored


def scored_rows(df: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """How many rows of each split a model of each horizon is fitted on or scored with."""
    return df.groupBy("split").agg(*[F.count(f"target_{h}").alias(str(h)) for h in horizons]).unpivot(
        "split", [str(h) for h in horizons], "horizon", "n_rows").withColumn("horizon", F.col("horizon").cast("int"))


def log_grid(low_exp: float, high_exp: float, n: int) -> list[float]:
    """Log-spaced values between two powers of ten."""
    step = (high_exp - low_exp) / max(n - 1, 1)
    return [10 ** (low_exp + i * step) for i in range(n)]


def grid_fit(spark: SparkSession, df: DataFrame, target: str, regs: Sequence[float], mixes: Sequence[float],
             parallelism: int = 4) -> DataFrame:
    """Fit every combination of settings on the training split and score it on the validation split."""
    return _fit_settings(df, target, [(r, m) for r in regs for m in mixes], parallelism)


def draw_fit(df: DataFrame, target: str, draws: DataFrame, reg: str, mix: str, parallelism: int = 4) -> DataFrame:
    """Fit the settings in two columns of ``draws`` (see ``joins.parameter_draws``); each is a job, so they are few."""
    settings = [tuple(row) for row in draws.select(reg, mix).distinct().orderBy(reg, mix).toLocalIterator()]
    return _fit_settings(df, target, settings, parallelism)


def _fit_settings(df: DataFrame, target: str, settings: Sequence[tuple[float, float]], parallelism: int) -> DataFrame:
    """Settings run side by side; each fit is a distributed job of its own, and only its score comes back."""
    labelled = df.where(F.col(target).isNotNull())
    train, val = labelled.where(F.col("split") == "train"), labelled.where(F.col("split") == "val")

    def one(setting: tuple[float, float]) -> tuple[float, float, bool, float | None, str | None]:
        reg, mix = setting
        try:
            model = LinearRegression(featuresCol="features", labelCol=target, predictionCol="yhat",
                                     regParam=reg, elasticNetParam=mix).fit(train)
            scored = model.transform(val).select(F.col(target).alias("y"), "yhat")
            return reg, mix, True, scored.agg(F.avg(F.abs(F.col("y") - F.col("yhat")))).first()[0], None
        except Exception as error:  # noqa: BLE001 - a failed setting is a result row
            return reg, mix, False, None, str(error)

    with ThreadPoolExecutor(parallelism) as pool:
        results = list(pool.map(one, settings))
    return df.sparkSession.createDataFrame(
        results, "reg_param double, elastic_net double, success boolean, val_mae double, error string")
