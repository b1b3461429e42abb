"""Word-weighted news sentiment and its resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import timeops
from barline.functions.text import parse_tone
from barline.operators import filters

SCORES = {"weighted_avg_tone": "tone", "weighted_avg_positive": "positive",
          "weighted_avg_negative": "negative", "weighted_avg_polarity": "polarity"}
AVERAGES = list(SCORES)


def _weighted(score: str, weight: Column) -> Column:
    return F.try_divide(F.sum(F.col(score) * weight), F.sum(weight))


def sentiment_aggregates(sources: Column | None = None) -> list[Column]:
    """Aggregates of one interval. Rows without a word count weigh 1; a missing score
    drops out of the numerator only. ``sources`` replaces the exact distinct count."""
    weight = F.coalesce("word_count", F.lit(1))
    return [
        *[_weighted(score, weight).alias(name) for name, score in SCORES.items()],
        F.count("*").alias("num_articles"),
        (F.count_distinct("source") if sources is None else sources).alias("num_sources"),
        F.sum(F.coalesce("word_count", F.lit(0))).alias("total_word_count"),
        F.min("tone").alias("min_tone"),
        F.max("tone").alias("max_tone"),
    ]


def select_articles(articles: DataFrame, topics: Sequence[str] | None = None, code: str = "US") -> DataFrame:
    """Relevant articles with parsed tone: topic, location and validity filters."""
    kept = filters.valid_tone(filters.location_filter(articles, code))
    return parse_tone(filters.topic_filter(kept, topics) if topics else kept)


def sentiment_15m(parsed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per 15-minute interval (and key)."""
    return parsed.groupBy(*keys, timeops.bucket_15m(F.col("ts")).alias("ts")).agg(*sentiment_aggregates())


def resample(df: DataFrame, frequency: str, method: str = "mean", keys: Sequence[str] = ()) -> DataFrame:
    """Coarser bars of sentiment rows, averages combined by ``method``.

    Averages are combined unweighted and distinct source counts are added; see
    ``resample_exact`` for the alternative. Bins without articles do not appear.
    """
    def combine(name: str) -> Column:
        c = F.col(name)
        at = F.when(c.isNotNull(), F.col("ts"))
        return {"mean": lambda: F.avg(c), "median": lambda: F.percentile(c, F.lit(0.5)),
                "first": lambda: F.min_by(c, at), "last": lambda: F.max_by(c, at)}[method]()

    binned = df.withColumn("__bin", timeops.resample_label(F.col("ts"), frequency))
    return (
        binned.groupBy(*keys, F.col("__bin").alias("ts"))
        .agg(*[combine(n).alias(n) for n in AVERAGES],
             *[F.sum(n).alias(n) for n in ("num_articles", "num_sources", "total_word_count")],
             F.min("min_tone").alias("min_tone"), F.max("max_tone").alias("max_tone"))
        .where(F.col("num_articles") > 0)
    )


def resample_exact(parsed: DataFrame, frequency: str, keys: Sequence[str] = ()) -> DataFrame:
    """Coarser bars straight from articles: word-weighted means, true source counts."""
    return parsed.groupBy(*keys, timeops.resample_label(F.col("ts"), frequency).alias("ts")).agg(*sentiment_aggregates())


def source_sketches(parsed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per 15-minute interval a mergeable distinct-source sketch and the weighted tone parts."""
    weight = F.coalesce("word_count", F.lit(1))
    return parsed.groupBy(*keys, timeops.bucket_15m(F.col("ts")).alias("ts")).agg(
        F.hll_sketch_agg("source").alias("sources"), F.sum(weight).alias("weight"),
        F.sum(F.col("tone") * weight).alias("tone_weight"))


def resample_sketches(df: DataFrame, frequency: str, keys: Sequence[str] = ()) -> DataFrame:
    """Roll interval sketches up without going back to articles."""
    return df.groupBy(*keys, timeops.resample_label(F.col("ts"), frequency).alias("__bin")).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sources")).alias("num_sources"),
        F.try_divide(F.sum("tone_weight"), F.sum("weight")).alias("weighted_avg_tone"),
    ).withColumnRenamed("__bin", "ts")


def topic_group_mean(df: DataFrame, names: Sequence[str], ts: str = "ts") -> DataFrame:
    """Average of the topic groups' features per timestamp."""
    return df.groupBy(ts).agg(*[F.avg(n).alias(n) for n in names])


def range_stats(df: DataFrame) -> DataFrame:
    """Counts of out-of-range values plus value ranges; ``valid`` when there are none."""
    tone, polarity = F.col("weighted_avg_tone"), F.col("weighted_avg_polarity")
    stats = df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.abs(tone) > 10).alias("bad_tone"),
        F.count_if(polarity < 0).alias("bad_polarity"),
        F.count_if(F.col("num_articles") <= 0).alias("zero_articles"),
        F.count_if(F.col("num_sources") <= 0).alias("zero_sources"),
        F.count_if(tone.isNull()).alias("null_tone"),
        F.min(tone).alias("min_tone"), F.max(tone).alias("max_tone"), F.avg(tone).alias("avg_tone"),
        F.min(polarity).alias("min_polarity"), F.max(polarity).alias("max_polarity"))
    issues = F.col("bad_tone") + F.col("bad_polarity") + F.col("zero_articles") + F.col("zero_sources")
    return stats.withColumn("valid", issues == 0)


def daily_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("ts").alias("dt")).agg(
        F.count("*").alias("intervals"), F.sum("num_articles").alias("articles"),
        F.sum("total_word_count").alias("words"), F.avg("weighted_avg_tone").alias("avg_tone"),
        F.min("min_tone").alias("min_tone"), F.max("max_tone").alias("max_tone"))


def extreme_days(df: DataFrame, top: int | None = 10) -> DataFrame:
    """The days with the lowest and the highest mean tone; without ``top`` all days on either side."""
    days = df.groupBy(F.to_date("ts").alias("dt")).agg(
        F.avg("weighted_avg_tone").alias("avg_tone"), F.sum("num_articles").alias("articles"))
    ranked = F.round("avg_tone", 9)
    first = lambda ordered: ordered if top is None else ordered.limit(top)
    low = first(days.orderBy(ranked.asc(), "dt")).withColumn("side", F.lit("lowest"))
    high = first(days.orderBy(ranked.desc(), "dt")).withColumn("side", F.lit("highest"))
    return low.unionByName(high)
