"""How much history indicators need before a requested start."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.timeops import BARS_PER_DAY, canonical
from barline.operators import indicators as I
from barline.operators import series as S


def periods_needed(names: Sequence[str]) -> int:
    """Rows the longest of the chosen indicators looks back, itself included."""
    return max(I.lookback(n) for n in names) + 1


def scan_days(frequency: str, periods: int) -> int:
    """Calendar days to rewind a scan: a fifth more than needed, and five days."""
    return math.floor(periods / BARS_PER_DAY.get(canonical(frequency), 1) * 1.2) + 5


def warmup_starts(df: DataFrame, periods: int, series: S.Series | None = None) -> DataFrame:
    """Per series the time of its row number ``periods``: the first full window."""
    series = series or S.bars()
    rows = S.with_position(df.select(*series.keys, "ts"), series)
    return rows.where(F.col("pos") == periods).select(*series.keys, F.col("ts").alias("indicator_value_start"))


def warmup_plan(df: DataFrame, requested_start: str, periods: int, series: S.Series | None = None) -> DataFrame:
    """Per series: where to start reading and where values start.

    Rows are counted, not days, so weekends do not eat into the history. With too
    little history the value start moves to the first full window.
    """
    series = series or S.bars()
    keys = list(series.keys)
    start = F.lit(requested_start).cast("date")
    rows = S.with_position(df.select(*keys, "ts", "dt"), series)
    history = df.groupBy(*keys).agg(F.count_if(F.col("dt") < start).alias("warmup_rows"))
    first = F.greatest(F.col("warmup_rows") - periods + 1, F.lit(1))
    return rows.join(history, keys).groupBy(*keys, "warmup_rows").agg(
        F.min(F.when(F.col("pos") >= first, F.col("dt"))).alias("fetch_start"),
        F.min(F.when((F.col("pos") >= periods) & (F.col("dt") >= start), F.col("dt"))).alias("indicator_value_start"))
