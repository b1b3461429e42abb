"""Adapters from the given tables to the engine's input shapes.

Each one reads only the columns it needs and aggregates with map-side combine, so
no key of the source tables ends up whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators import series as S

BASKET = ("AF", "NF", "RF")
BASKET_WEIGHTS = {"AF": 0.5, "NF": 0.3, "RF": 0.2}
BAR_TICKERS = ("AF", "AO", "NF", "NO", "RF", "RO")
PREDICTION_HORIZONS = (7, 14)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV bars per return flag and line status."""
    tie = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat("l_returnflag", "l_linestatus").alias("ticker"),
                 F.col("l_shipdate").cast("date").alias("dt"))
        .agg(F.min_by(price, tie).alias("open"), F.max(price).alias("high"),
             F.min(price).alias("low"), F.max_by(price, tie).alias("close"),
             F.sum(qty).alias("volume"),
             F.try_divide(F.sum(price * qty), F.sum(qty)).alias("vwap"),
             F.count("*").alias("transactions"))
        .select("ticker", F.col("dt").cast("timestamp").alias("ts"), "dt",
                F.lit("daily").alias("frequency"), "open", "high", "low", "close",
                "volume", "vwap", "transactions")
    )


def sparse_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean order value per priority; many days are missing."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("ticker"),
                 F.col("o_orderdate").cast("date").alias("dt"))
        .agg(F.avg("o_totalprice").alias("close"), F.count("*").cast("double").alias("volume"))
        .select("ticker", F.col("dt").cast("timestamp").alias("ts"), "dt",
                F.lit("daily").alias("frequency"), "close", "volume")
    )


def _digits(n: int) -> Column:
    return F.floor(F.col("value")).cast("long") % n


def articles_from(events: DataFrame) -> DataFrame:
    """Article rows with packed tone, themes and locations (batch or streaming)."""
    tone, pos, neg = _digits(21) - 10, _digits(7), _digits(5)
    words = F.when(F.col("event_type") == "error", F.lit("")).otherwise(
        F.concat(F.lit(","), F.regexp_extract("props", "([0-9]+)", 1)))
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("article_id"), ts.alias("ts"), ts.cast("date").alias("dt"),
        F.concat(F.concat_ws(",", tone.cast("string"), pos.cast("string"), neg.cast("string"),
                             (pos + neg).cast("string"), F.lit("1"), F.lit("2")), words).alias("v2tone"),
        F.concat(F.upper("event_type"), F.lit(";K"), (F.col("user_id") % 9).cast("string")).alias("v2themes"),
        F.when(F.col("user_id") % 4 == 0, "1#UK#").otherwise("1#US#").alias("v2locations"),
        F.col("user_id").cast("string").alias("source"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_from(table(spark, sf_dir, "events"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; event time is a zoned timestamp."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def ticks_from(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.col("value").alias("price"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("volume"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_from(table(spark, sf_dir, "events"))


def trends_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search interest 0-100 per keyword and day, scaled to each keyword's peak."""
    counts = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("keyword"), F.col("ts").cast("date").alias("dt"))
        .agg(F.count("*").alias("n"))
    )
    peak = counts.groupBy("keyword").agg(F.max("n").alias("peak"))
    return counts.join(peak, "keyword").select(
        "dt", "keyword", F.floor(F.lit(100.0) * F.col("n") / F.col("peak")).cast("double").alias("interest"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence forecasts at two horizons in long form."""
    horizons = PREDICTION_HORIZONS
    close = F.col("close")
    step = S.columns(
        **{f"f{h}": (lambda w, h=h: F.lead(close, h).over(w)) for h in horizons},
        **{f"l{h}": (lambda w, h=h: F.lag(close, h).over(w)) for h in horizons})
    wide = S.over_blocks(bars(spark, sf_dir).select("ticker", "frequency", "ts", "dt", "close"),
                         S.bars(), [step], before=max(horizons), after=max(horizons))
    pairs = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("ahead"), F.col(f"l{h}").alias("behind"))
        for h in horizons])).alias("h")
    return (
        wide.where(close > 0).select("ticker", "dt", F.col("pos").alias("sample_id"), "close", pairs)
        .where(F.col("h.ahead").isNotNull() & (F.col("h.behind") > 0))
        .select("ticker", "dt", "sample_id", F.col("h.horizon").alias("horizon"),
                (F.col("h.ahead") / close - 1).alias("y"), (close / F.col("h.behind") - 1).alias("yhat"))
    )


TAGS = {"click": "Loss/val", "view": "Metrics/MAE", "signup": "Metrics/DirectionalAccuracy",
        "purchase": "Metrics/PerHorizon/H7_MAE"}


def run_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training scalars (run, tag, step, value); run names carry parameters."""
    tag = F.lit("Metrics/PerHorizon/H14_MAE")
    for kind, name in TAGS.items():
        tag = F.when(F.col("event_type") == kind, name).otherwise(tag)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    stepped = S.with_position(events, S.timed(("user_id", "event_type"), ("ts", "event_id")))
    user = F.col("user_id")
    return stepped.select(
        F.concat(F.lit("reg_md0."), (user % 3).cast("string"), F.lit("_wd0.0"), (user % 5).cast("string"),
                 F.lit("_gc0.5_fd0."), user.cast("string")).alias("run"),
        tag.alias("tag"), (F.col("pos") - 1).alias("step"), "value")
