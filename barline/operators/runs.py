"""Comparing training runs from their scalars and logs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import text
from barline.operators import series as S
from barline.session import settle

# Points of a skyline that one task compares.
SKYLINE_BLOCK = 8192


def best_step(df: DataFrame) -> DataFrame:
    """Per run and tag: smallest and largest value, their steps, last value, count.

    The smallest value takes its earliest step, the largest its latest.
    """
    return df.groupBy("run", "tag").agg(
        F.min("value").alias("min_value"), F.min_by("step", F.struct("value", "step")).alias("min_step"),
        F.max("value").alias("max_value"), F.max_by("step", F.struct("value", "step")).alias("max_step"),
        F.max_by("value", "step").alias("last_value"), F.count("*").alias("n"))


def early_stop(df: DataFrame, patience: int, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Step at which training would stop and the best step until then, per run.

    An improvement is a value strictly below everything before it.
    """
    series = S.stepped(keys, "step")
    rows = S.running(df, series, sums={"__pos": F.lit(1).cast("long")}, mins={"__best": F.col("value")},
                     before_row=("__best",))
    better = F.col("__best").isNull() | (F.col("value") < F.col("__best"))
    rows = S.running(rows, series, lasts={"__at": F.when(better, F.struct("step", "value", "__pos"))})
    waited = F.col("__pos") - F.col("__at.__pos")
    stop = F.when(waited >= patience, F.struct("step", "__at"))
    last = F.struct("step", "__at")
    out = rows.groupBy(*keys).agg(F.min_by(stop, F.when(waited >= patience, F.col("step"))).alias("s"),
                                  F.max_by(last, "step").alias("e"), F.count("*").alias("n_steps"))
    at = F.coalesce("s", "e")
    return out.select(*keys, F.col("s").isNotNull().alias("stopped"), at["step"].alias("stop_step"),
                      at["__at"]["step"].alias("best_step"), at["__at"]["value"].alias("best_value"), "n_steps")


def run_table(df: DataFrame, tags: dict[str, str], params: Sequence[str]) -> DataFrame:
    """One row per run: parameters from its name, best and final value of each tag.

    ``tags`` maps scalar tags to column names.
    """
    aggs: list[Column] = []
    for tag, name in tags.items():
        v = F.when(F.col("tag") == tag, F.col("value"))
        aggs += [F.min(v).alias(f"best_{name}"),
                 F.max_by(v, F.when(F.col("tag") == tag, F.col("step"))).alias(f"final_{name}")]
    return df.groupBy("run").agg(*aggs).withColumns(text.run_params(F.col("run"), params))


def test_metrics(df: DataFrame, candidates: Sequence[str], final_tag: str) -> DataFrame:
    """First non-zero best value among alternative tags, and the last value of one tag."""
    best = [F.nullif(F.min(F.when(F.col("tag") == t, F.col("value"))), F.lit(0.0)) for t in candidates]
    return df.groupBy("run").agg(
        F.coalesce(*best).alias("best"),
        F.max_by(F.when(F.col("tag") == final_tag, F.col("value")),
                 F.when(F.col("tag") == final_tag, F.col("step"))).alias("final"))


def best_trial(df: DataFrame, metric: str, tie: str) -> DataFrame:
    """Trials from best to worst: larger is better only for accuracies, missing last."""
    c = F.col(metric)
    order = c.desc_nulls_last() if "accuracy" in metric.lower() else c.asc_nulls_last()
    return df.orderBy(order, tie)


def horizon_table(df: DataFrame) -> DataFrame:
    """Best error per run and horizon tag, long form."""
    return df.withColumns(text.parse_tag(F.col("tag"))).where(
        F.col("horizon").isNotNull() & (F.col("metric") == "MAE")).groupBy("run", "horizon").agg(
        F.min("value").alias("best_mae"))


def wide_horizons(table: DataFrame, value: str = "best_mae") -> tuple[DataFrame, list[str]]:
    """One row per run with a column ``h{horizon}`` for every horizon that the table reports, and their names."""
    horizons = sorted(r["horizon"] for r in table.select("horizon").distinct().collect())  # as many as columns
    names = [f"h{h}" for h in horizons]
    return table.groupBy("run").agg(*(F.max(F.when(F.col("horizon") == h, F.col(value))).alias(n) for h, n in zip(horizons, names))), names


def skyline(points: np.ndarray) -> np.ndarray:
    """Which points no other point is strictly below in every coordinate."""
    # What beats a point has a smaller sum (rounded: no larger) and a smaller first coordinate, so it is met before.
    order = np.lexsort((points[:, 0], points.sum(axis=1)))
    rest, kept = order, []
    while len(rest):
        best = rest[0]
        kept.append(best)
        rest = rest[1:][~(points[best] < points[rest[1:]]).all(axis=1)]
    out = np.zeros(len(points), bool)
    out[kept] = True
    return out


def undominated(wide: DataFrame, metrics: Sequence[str], key: str = "run", block: int = SKYLINE_BLOCK, seeds: int = 64) -> DataFrame:
    """Runs that no other run beats strictly on every metric, with their mean; any number of metrics.

    Order-free form of scanning runs and keeping one only if it is better on all horizons. Runs without one of the
    metrics take no part; runs with equal metrics stay or go together.

    A few points with small sums rule out most others where they lie. What is left shrinks to the skyline of each
    partition, is dealt anew into fewer partitions, and so on up a tree, while that removes anything. If more than one
    block stays, each block is checked against every other one. No task holds more than a partition's own skyline.
    """
    metrics = list(metrics)
    points = wide.withColumns({m: F.when(~F.isnan(m), F.col(m).cast("double")) for m in metrics}).dropna("any", subset=metrics)
    vectors = settle(points.select(*metrics).distinct(), "metric-vectors")
    schema = vectors.schema

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame])
            held = held[skyline(held.to_numpy(float))]
        if held is not None:
            yield held

    total = sum((F.col(m) for m in metrics), F.lit(0.0))
    strong = vectors.orderBy(total, *metrics).limit(seeds).collect()
    if strong:
        array = F.array(*(F.struct(*(F.lit(float(r[m])).alias(f"x{k}") for k, m in enumerate(metrics))) for r in strong))
        vectors = vectors.where(~F.exists(array, lambda p: reduce(and_, (p[f"x{k}"] < F.col(m) for k, m in enumerate(metrics)))))
    left, n = settle(vectors.mapInPandas(local, schema), "skylines"), None
    while True:
        before, n = n, left.count()
        parts = math.ceil(n / block)
        if parts <= 1 or (before is not None and n > 0.9 * before):
            break
        left = settle(left.repartition(parts, *metrics).mapInPandas(local, schema), "skylines")
    if parts <= 1:
        left = left.coalesce(1).mapInPandas(local, schema)
    else:
        left = _checked_by_blocks(left, metrics, parts)
    return points.join(left, metrics).select(key, *metrics, (total / len(metrics)).alias("mean_mae"))


def _checked_by_blocks(vectors: DataFrame, metrics: list[str], parts: int) -> DataFrame:
    """``vectors`` that none of them beats: each block against each block."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own, other in zip(frame["own"], frame["other"]):
                mine, theirs = (np.array([[v[m] for m in metrics] for v in side]) for side in (own, other))
                beaten = np.zeros(len(mine), bool)
                for point in theirs:
                    beaten |= (point < mine).all(axis=1)
                yield pd.DataFrame(mine[beaten], columns=metrics)

    dealt = vectors.withColumn("__block", F.pmod(F.xxhash64(*metrics), F.lit(parts)))
    packed = settle(dealt.groupBy("__block").agg(F.collect_list(F.struct(*metrics)).alias("points")), "skyline-blocks")
    own = packed.select(F.col("points").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("__block"))
    met = own.join(packed.select("__block", F.col("points").alias("other")), "__block").select("own", "other")
    return vectors.join(met.mapInPandas(check, vectors.schema).distinct(), metrics, "left_anti")


def search_summary(df: DataFrame, ok: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def enrich_results(results: DataFrame, logs: DataFrame) -> DataFrame:
    """Search results joined to what their logs say, best first, failures last."""
    best = text.best_log_epoch(logs)
    return results.join(best, "run", "left").orderBy(F.col("best_val_loss").asc_nulls_last(), "run")
