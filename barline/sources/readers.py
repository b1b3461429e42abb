"""Scans and file sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VENDOR_BAR = T.StructType([
    T.StructField("t", T.LongType()), T.StructField("o", T.DoubleType()), T.StructField("h", T.DoubleType()),
    T.StructField("l", T.DoubleType()), T.StructField("c", T.DoubleType()), T.StructField("v", T.DoubleType()),
    T.StructField("vw", T.DoubleType()), T.StructField("n", T.LongType())])
VENDOR_PAGE = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("frequency", T.StringType()),
    T.StructField("results", T.ArrayType(VENDOR_BAR))])


def scan_bars(df: DataFrame, tickers: Sequence[str], start: str, end: str, frequency: str,
              columns: Sequence[str]) -> DataFrame:
    """Range scan of chosen tickers and columns; ordering is left to the consumer."""
    return (df.where(F.col("ticker").isin(list(tickers)) & (F.col("frequency") == frequency)
                     & F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
            .select("ticker", "dt", "frequency", *columns))


def scan_articles(df: DataFrame, start: str, end: str, compact: str | None = None) -> DataFrame:
    """Articles of a day range: the partition column prunes, the exact time refines.

    ``compact`` names the ``yyyyMMddHHmmss`` number column, where there is one.
    """
    pruned = df.where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if compact is None:
        return pruned
    low, high = int(start.replace("-", "") + "000000"), int(end.replace("-", "") + "235959")
    return pruned.where(F.col(compact).between(low, high))


def detect_features(schema: T.StructType, exclude: Sequence[str]) -> list[str]:
    """Numeric columns that are neither targets nor dates."""
    return [f.name for f in schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def load(spark: SparkSession, path: str, fmt: str, exclude: Sequence[str], schema: T.StructType | None = None,
         keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns (detected) of a CSV or Parquet file set, plus ``keep``."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.format(fmt).load(path)
    return df.select(*keep, *[c for c in detect_features(df.schema, exclude) if c not in keep])


def scan_template(spark: SparkSession, template: str, args: Mapping[str, object], **frames: DataFrame) -> DataFrame:
    """SQL text with ``{frame}`` sources and ``:name`` parameters."""
    return spark.sql(template, args=dict(args), **frames)


def landed_bars(pages: DataFrame) -> DataFrame:
    """Vendor JSON pages (``results`` arrays) to canonical bar rows, times in UTC."""
    rows = pages.select("ticker", "frequency", F.explode("results").alias("r"))
    ts = F.timestamp_millis(F.col("r.t"))
    return rows.select(
        "ticker", ts.alias("ts"), ts.cast("date").alias("dt"), "frequency",
        F.col("r.o").alias("open"), F.col("r.h").alias("high"), F.col("r.l").alias("low"), F.col("r.c").alias("close"),
        F.col("r.v").alias("volume"), F.col("r.vw").alias("vwap"), F.col("r.n").alias("transactions"),
        F.current_timestamp().alias("ingested_at"))


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    return landed_bars(spark.read.schema(VENDOR_PAGE).json(path))


def parse_landed(df: DataFrame, column: str) -> DataFrame:
    """Same, for JSON text already in a column."""
    return landed_bars(df.select(F.from_json(column, VENDOR_PAGE).alias("p")).select("p.*"))


def vendor_pages(bars: DataFrame) -> DataFrame:
    """Bars in the vendor's JSON shape, one page per row."""
    bar = F.struct(
        F.unix_millis("ts").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
        F.col("close").alias("c"), F.col("volume").alias("v"), F.col("vwap").alias("vw"),
        F.col("transactions").alias("n"))
    return bars.select(F.to_json(F.struct("ticker", "frequency", F.array(bar).alias("results"))).alias("value"))


def scan_article_days(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Articles of the days from ``start`` to ``end``; the folders of other days are not opened."""
    return spark.read.parquet(path).where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
