"""Frequencies, buckets, calendar spines and calendar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted frequency spellings and their canonical name.
FREQUENCY_ALIASES = {
    "1m": "1m", "1min": "1m",
    "5m": "5m", "5min": "5m",
    "15m": "15m", "15min": "15m",
    "30m": "30m", "30min": "30m",
    "1h": "1h", "hourly": "1h", "h": "1h",
    "4h": "4h",
    "1d": "1d", "daily": "1d", "d": "1d",
    "1w": "1w", "weekly": "1w", "w": "1w",
}

# Seconds in one period.
STEP_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1_800, "1h": 3_600, "4h": 14_400, "1d": 86_400, "1w": 604_800}

# Bars expected in one day (24-hour market).
BARS_PER_DAY = {"1m": 1440, "5m": 288, "15m": 96, "30m": 48, "1h": 24, "4h": 6, "1d": 1}


def canonical(frequency: str) -> str:
    return FREQUENCY_ALIASES[frequency]


def _case(column: Column, table: dict[str, object], default: Column) -> Column:
    out = default
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def canonical_frequency(column: Column) -> Column:
    """Canonical frequency name; unknown spellings pass through."""
    return _case(column, FREQUENCY_ALIASES, column)


def step_seconds(column: Column) -> Column:
    """Length of one period in seconds; a day for a missing name, an error for an unknown one."""
    table = {alias: STEP_SECONDS[name] for alias, name in FREQUENCY_ALIASES.items()}
    unknown = F.raise_error(F.concat(F.lit("unknown frequency "), column)).cast("int")
    return _case(column, table, F.when(column.isNull(), 86_400).otherwise(unknown)).cast("long")


def bars_per_day(column: Column) -> Column:
    table = {alias: BARS_PER_DAY[name] for alias, name in FREQUENCY_ALIASES.items() if name in BARS_PER_DAY}
    return _case(column, table, F.lit(1)).cast("long")


def floor_to(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of ``seconds`` that holds ``ts``."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def bucket_15m(ts: Column) -> Column:
    return floor_to(ts, 900)


def parse_compact(number: Column) -> Column:
    """``yyyyMMddHHmmss`` (number or text) to timestamp; NULL when malformed."""
    return F.try_to_timestamp(number.cast("string"), F.lit("yyyyMMddHHmmss"))


def resample_label(ts: Column, frequency: str) -> Column:
    """Bin label of a resampled row: left edge, except weeks, labelled by their Sunday."""
    name = canonical(frequency)
    if name == "1w":
        return F.next_day(F.date_sub(ts.cast("date"), 1), "SU").cast("timestamp")
    if name == "1d":
        return F.date_trunc("day", ts)
    return floor_to(ts, STEP_SECONDS[name])


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    c = F.col(ts)
    return df.withColumns({
        "hour": F.hour(c).cast("long"),
        "day_of_week": F.weekday(c).cast("long"),
        "day_of_month": F.day(c).cast("long"),
        "month": F.month(c).cast("long"),
        "is_weekend": (F.weekday(c) >= 5).cast("long"),
    })


def cyclical_encode(df: DataFrame) -> DataFrame:
    """Sine and cosine of the calendar features."""
    out = {}
    for name, column, period in (("hour", "hour", 24), ("day", "day_of_week", 7), ("month", "month", 12)):
        angle = F.lit(2.0) * F.pi() * F.col(column) / F.lit(float(period))
        out[f"{name}_sin"], out[f"{name}_cos"] = F.sin(angle), F.cos(angle)
    return df.withColumns(out)


def calendar_spine(bounds: DataFrame, start: str, end: str, frequency: str, name: str = "ts") -> DataFrame:
    """One row per period between two timestamp columns of ``bounds``.

    A long spine is unfolded in two steps (days, then periods in the day), so no
    single array grows with the sub-day frequency.
    """
    seconds = STEP_SECONDS[canonical(frequency)]
    rest = [c for c in bounds.columns if c not in (start, end)]
    if seconds >= 86_400:
        step = F.make_interval(days=F.lit(seconds // 86_400))
        return bounds.select(*rest, F.explode(F.sequence(F.col(start), F.col(end), step)).alias(name))
    per_day = 86_400 // seconds
    days = bounds.select(
        *rest, start, end,
        F.explode(F.sequence(F.date_trunc("day", start), F.date_trunc("day", end),
                             F.make_interval(days=F.lit(1)))).alias("__day"))
    slots = days.select(
        *rest, start, end,
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(per_day - 1)),
                              lambda i: F.timestamp_seconds(F.unix_seconds("__day") + i * seconds))).alias(name))
    return slots.where(F.col(name).between(F.col(start), F.col(end))).select(*rest, name)
