"""Row and column selection."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.text import upper_snake


def topic_filter(df: DataFrame, topics: Sequence[str], themes: str = "v2themes") -> DataFrame:
    """Articles mentioning any topic, matched literally (no wildcard meaning of ``_``).

    A topic matches anywhere in the themes, however long the list is: one alternation
    of escaped names, so an article is read once.
    """
    wanted = [re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", t.upper().replace(" ", "_")) for t in topics]
    return df.where(F.col(themes).rlike("|".join(wanted)) if wanted else F.lit(False))


def topic_groups(df: DataFrame, groups: dict[str, Sequence[str]], themes: str = "v2themes") -> DataFrame:
    """One row per article and topic group it belongs to, as ``topic_group_id``."""
    def member(topics: Sequence[str]) -> Column:
        test = F.lit(False)
        for topic in topics:
            test = test | F.contains(F.col(themes), upper_snake(F.lit(topic)))
        return test

    ids = F.array_compact(F.array(*[F.when(member(t), F.lit(g)) for g, t in groups.items()]))
    return df.withColumn("topic_group_id", F.explode(ids))


def location_filter(df: DataFrame, code: str = "US", locations: str = "v2locations") -> DataFrame:
    return df.where(F.contains(F.col(locations), F.lit(f"#{code}#")))


def valid_tone(df: DataFrame, packed: str = "v2tone", min_words: int | None = None) -> DataFrame:
    """Rows with a tone string; with ``min_words`` also enough words (needs ``word_count``)."""
    kept = df.where(F.col(packed).isNotNull() & (F.length(packed) > 0))
    return kept if min_words is None else kept.where(F.col("word_count") >= min_words)


def weekend_filter(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.where(F.weekday(ts) < 5)


def range_violations(df: DataFrame, order: Sequence[str], top: int | None = 20) -> DataFrame:
    """Rows with tone outside +-10 or negative polarity, strongest first."""
    tone, polarity = F.col("weighted_avg_tone"), F.col("weighted_avg_polarity")
    found = (df.where((F.abs(tone) > 10) | (polarity < 0))
            .orderBy(F.abs(tone).desc(), *order))
    return found if top is None else found.limit(top)


def any_non_null(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.where(F.coalesce(*names).isNotNull())


def drop_all_null(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.dropna("all", subset=list(names))


def select_prefixes(df: DataFrame, keys: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """Key columns plus all columns whose name starts with one of the prefixes."""
    return df.select(*keys, *[c for c in df.columns if c not in keys and c.startswith(tuple(prefixes))])


def warmup_cut(df: DataFrame, starts: DataFrame, keys: Sequence[str], start: str = "indicator_value_start",
               ts: str = "ts") -> DataFrame:
    """Drop each series' rows before its own start time; series without one are dropped."""
    return df.join(starts.select(*keys, start), list(keys)).where(F.col(ts) >= F.col(start)).drop(start)


def align_range(frames: Sequence[DataFrame], ts: str = "dt", start: Column | None = None,
                end: Column | None = None) -> list[DataFrame]:
    """Cut all frames to the range they share (or to the one given)."""
    bounds = [f.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")) for f in frames]

    def all_of(pick: Callable[..., Column], name: str) -> Column:
        values = [b.select(name).scalar() for b in bounds]
        return pick(*values) if len(values) > 1 else values[0]

    low = start if start is not None else all_of(F.greatest, "lo")
    high = end if end is not None else all_of(F.least, "hi")
    return [f.where(F.col(ts).between(low, high)) for f in frames]
