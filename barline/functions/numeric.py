"""Numeric guards and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(column: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(column) & (F.abs(column) != F.lit(float("inf"))), column)


def finite_columns(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: finite(F.col(n)) for n in (names or floats)})


def ratio(a: Column, b: Column) -> Column:
    """Quotient, NULL for a zero or missing denominator."""
    return F.try_divide(a, b)


def log1p_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.log1p(F.col(n).cast("double")) for n in names})


def relative_diff(a: Column, b: Column) -> Column:
    """|a - b| / |b|; against zero: 0 when both are zero, else NULL."""
    return F.when(b == 0, F.when(a == 0, 0.0)).otherwise(F.try_divide(F.abs(a - b), F.abs(b)))


def compare_summary(df: DataFrame, pairs: Sequence[tuple[str, str, str]], tolerance: float) -> DataFrame:
    """Per indicator: compared rows, rows beyond tolerance, share, largest differences.

    ``pairs`` lists (name, computed column, stored column). One aggregate pass.
    """
    aggs = []
    for name, a, b in pairs:
        ca, cb = F.col(a), F.col(b)
        rel = relative_diff(ca, cb)
        both = ca.isNotNull() & cb.isNotNull()
        n, bad = F.count_if(both), F.count_if(both & (F.coalesce(rel, F.lit(float("inf"))) > tolerance))
        aggs.append(F.struct(
            F.lit(name).alias("indicator"), n.alias("compared"), bad.alias("beyond"),
            (F.try_divide(bad, n) * 100).alias("beyond_pct"), F.max(F.abs(ca - cb)).alias("max_abs"),
            F.max(rel).alias("max_rel")).alias(name))
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.col(n) for n, _, _ in pairs])))
