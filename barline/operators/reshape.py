"""Pivots, unpivots, unions and ordering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_wide(df: DataFrame, index: str, members: Sequence[str], values: Sequence[str], by: str = "ticker") -> DataFrame:
    """One row per ``index`` with columns ``{member}_{value}``. The member list is
    given, so no extra job looks for it and the width is known."""
    aggs = [F.first(v, ignorenulls=True).alias(v) for v in values]
    wide = df.groupBy(index).pivot(by, list(members)).agg(*aggs)
    if len(values) == 1:
        wide = wide.withColumnsRenamed({m: f"{m}_{values[0]}" for m in members})
    return wide


def pivot_features(df: DataFrame, members: Sequence[str], member_features: Sequence[str], shared: Sequence[str] = (),
                   ts: str = "ts", by: str = "ticker") -> DataFrame:
    """One row per timestamp: ``{feature}_{member}`` columns, then shared features.

    Shared features take the first non-null value in member order. Everything comes
    from one grouped pass, aggregated before the shuffle.
    """
    aggs: list[Column] = [
        F.max(F.when(F.col(by) == m, F.col(f))).alias(f"{f}_{m}") for f in member_features for m in members]
    aggs += [F.min_by(s, F.when(F.col(s).isNotNull(), F.col(by))).alias(s) for s in shared]
    return df.groupBy(ts).agg(*aggs)


def unpivot_long(df: DataFrame, keys: Sequence[str], names: Sequence[str], label: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(names), label, value)


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sort_by(df: DataFrame, *order: str | Column) -> DataFrame:
    """Total order; Spark range-partitions, so no task holds everything."""
    return df.orderBy(*order)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The ``k`` first rows of each group. Spark limits each group per input
    partition before the shuffle, so a large group sends few rows."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def _draw(keys: Sequence[str], seed: int) -> Column:
    """Pseudo-random order from the key itself: the same after a retry, unlike rand(), and in other engines."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def random_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(_draw(keys, seed), *keys).limit(n)


def shuffle(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    return df.orderBy(_draw(keys, seed), *keys)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct().orderBy(*keys)
