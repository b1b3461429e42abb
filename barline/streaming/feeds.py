"""Structured Streaming forms of the sentiment, bar and maintenance operators (ST1-ST6, ST8)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators.merge import dedupe
from barline.operators.sentiment import SCORES
from barline.session import work_dir
from barline.sources.writers import delete_folder, rewrite_partitions


def sentiment_15m(parsed: DataFrame, delay: str = "1 hour", width: str = "15 minutes") -> DataFrame:
    """Windowed sentiment over an article stream; rows later than ``delay`` are dropped.

    Articles are first combined per interval and source, then per interval. The
    source count stays exact without keeping sets in state, and a busy interval is
    spread over its sources.
    """
    weight = F.coalesce("word_count", F.lit(1))
    per_source = parsed.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("window"), "source").agg(
        *[F.sum(F.col(s) * weight).alias(f"__{s}") for s in SCORES.values()],
        F.sum(weight).alias("__weight"), F.count("*").alias("__n"),
        F.sum(F.coalesce("word_count", F.lit(0))).alias("__words"),
        F.min("tone").alias("__min"), F.max("tone").alias("__max"))
    return per_source.groupBy("window").agg(
        *[F.try_divide(F.sum(f"__{s}"), F.sum("__weight")).alias(n) for n, s in SCORES.items()],
        F.sum("__n").alias("num_articles"), F.count("*").alias("num_sources"),
        F.sum("__words").alias("total_word_count"), F.min("__min").alias("min_tone"), F.max("__max").alias("max_tone"))


def rollup(intervals: DataFrame, width: str = "1 day") -> DataFrame:
    """Coarser windows chained onto ``sentiment_15m``."""
    return intervals.groupBy(F.window(F.window_time("window"), width).alias("window")).agg(
        *[F.avg(n).alias(n) for n in SCORES],
        F.sum("num_articles").alias("num_articles"), F.sum("num_sources").alias("num_sources"),
        F.sum("total_word_count").alias("total_word_count"),
        F.min("min_tone").alias("min_tone"), F.max("max_tone").alias("max_tone"))


def ohlc(ticks: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour",
         tie: str = "event_id") -> DataFrame:
    """OHLCV bars from a tick stream, tumbling or sliding."""
    at = F.struct("ts", tie)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    p, v = F.col("price"), F.col("volume")
    return ticks.withWatermark("ts", delay).groupBy("ticker", window.alias("window")).agg(
        F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"),
        F.sum(v).alias("volume"), F.try_divide(F.sum(p * v), F.sum(v)).alias("vwap"), F.count("*").alias("transactions"))


def deduplicated(rows: DataFrame, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """First arrival of each key within the watermark."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def quiet_periods(rows: DataFrame, keys: Sequence[str], gap: str, delay: str = "1 hour") -> DataFrame:
    """An alert for every run of activity followed by at least ``gap`` of silence."""
    return rows.withWatermark("ts", delay).groupBy(*keys, F.session_window("ts", gap).alias("session")).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def upsert_into(path: str, partition: str, keys: Sequence[str], order: Sequence[str],
                change: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function keeping the last row per key in a Parquet table.

    Stored and new rows of the touched partitions compete by ``order``, so replaying
    a batch, or receiving batches out of order, gives the same table. A ledger next to
    the table (see ``commits``) gets a batch's number once its rewrite has ended: a
    batch found there changes nothing, one that was cut short before is done again.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entry = f"{path}_commits/batch_id={batch_id}"
        if table_exists(spark, entry):
            return
        # The batch is used twice (touched partitions, rows): keep it in the shared folder.
        held = f"{work_dir(spark, 'batch')}-{batch_id}"
        dedupe(change(batch), keys, order).write.parquet(held)
        rows = spark.read.parquet(held)
        if not rows.isEmpty():
            if not table_exists(spark, path):
                rows.repartitionByRange(partition, *keys).write.mode("overwrite").partitionBy(partition).parquet(path)
            else:
                rewrite_partitions(spark, path, rows, partition,
                                   lambda stored: dedupe(stored.unionByName(rows.select(stored.columns)), keys, order))
        rows.agg(F.count("*").alias("n_rows")).write.mode("overwrite").parquet(entry)
        delete_folder(spark, held)

    return run


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``batch_id`` and ``n_rows`` of the batches whose upsert into ``path`` has ended."""
    return spark.read.schema("n_rows long, batch_id long").parquet(f"{path}_commits").select("batch_id", "n_rows")


def watch_late(path: str, delay: str = "1 hour", width: str = "15 minutes") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that tells rows on time from late ones, interval by interval.

    A row is late if its interval had ended ``delay`` before the latest time of all earlier batches, which is when a
    watermark drops it. Under ``path``, by batch: ``marks`` (latest time), ``counts`` (interval, rows on time and
    late) and ``late`` (the late rows themselves, to be applied again). A replayed batch writes the same again.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = read_batches(spark, path, "marks", "ts timestamp").where(F.col("batch_id") < batch_id)
        mark = earlier.agg(F.max("ts")).scalar()
        late = F.coalesce(F.col("window.end") <= mark - F.expr(f"INTERVAL {delay}"), F.lit(False))
        rows = batch.where("ts IS NOT NULL").withColumn("window", F.window("ts", width)).withColumn("is_late", late)

        def keep(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")

        keep(rows.groupBy(F.col("window.start").alias("ts")).agg(
            F.count_if(~F.col("is_late")).alias("on_time"), F.count_if("is_late").alias("late")), "counts")
        keep(rows.where("is_late").drop("window", "is_late"), "late")
        # Last, so that a batch cut short finds the marks it found at first.
        keep(batch.agg(F.max("ts").alias("ts")), "marks")

    return run


def read_batches(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """What ``watch_late`` has kept under a name, with its ``batch_id``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{schema}, batch_id long")
    return spark.read.schema(f"{schema}, batch_id long").parquet(f"{path}/{name}")


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """``ts`` (start of an interval), rows ``on_time`` and ``late`` over all batches."""
    return read_batches(spark, path, "counts", "ts timestamp, on_time long, late long").groupBy("ts").agg(
        F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has ended, or partitions are there: overwriting partitions leaves no other mark."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return False
    return any(n == "_SUCCESS" or ("=" in n and not n.startswith(".")) for n in (
        s.getPath().getName() for s in system.listStatus(folder)))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into Parquet files, then stop."""
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def closed_window(df: DataFrame, start: str) -> DataFrame:
    """Window start as a plain column."""
    return df.withColumn(start, F.col("window.start")).drop("window")

