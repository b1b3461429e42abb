"""The whole indicator set kept up to date as bars arrive, late bars included (ST7).

A table of bars with their indicators is stored by period. A batch names, series by series, the earliest bar it brings;
indicators of that bar and of all later ones are computed anew from the stored bars before it, and nothing else is read.
How far back that reaches follows from the indicators: an exponential average forgets, a rolling one has a window, and
on-balance volume continues from its stored value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.numeric import finite_columns
from barline.operators import indicators as I
from barline.operators import series as S
from barline.operators.merge import dedupe
from barline.session import work_dir
from barline.sources.writers import delete_folder, rewrite_partitions
from barline.streaming.feeds import table_exists

KEYS, VALUES = ["ticker", "frequency"], ["open", "high", "low", "close", "volume"]
LEDGER = "n_rows long, n_late long, n_corrected long, n_skipped long"


def _period(period: str) -> Column:
    return F.date_format(F.date_trunc(period, "ts"), "yyyyMMdd").cast("int")


def _starts(fresh: DataFrame, parts: DataFrame | None, history: int) -> DataFrame:
    """One row a series of the batch: its first bar, its last stored bar and the period from which stored bars are needed.

    That is the latest period with ``history`` known closes between it and the period of the first bar, else the first
    period. ``parts`` has one row a series and period, so the running count is over the calendar, not over bars.
    """
    first = fresh.groupBy(*KEYS).agg(F.min("ts").alias("__start"), F.min("part").alias("__part"))
    if parts is None:
        return first.withColumns({"__from": F.col("__part"), "__last": F.lit(None).cast("timestamp")})
    met = parts.join(first, KEYS)
    back = Window.partitionBy(*KEYS).orderBy(F.col("part").desc())
    older = F.col("part") < F.col("__part")
    known = met.withColumn("__known", F.sum(F.when(older, F.col("n_known")).otherwise(0)).over(back))
    reach = known.groupBy(*KEYS).agg(
        F.coalesce(F.max(F.when(older & (F.col("__known") >= history), F.col("part"))), F.min("part")).alias("__from"),
        F.max("last_ts").alias("__last"))
    return first.join(reach, KEYS, "left").withColumn("__from", F.least(F.coalesce("__from", "__part"), "__part"))


def indicators_into(path: str, names: Sequence[str] = tuple(I.STORED), period: str = "year",
                    series: S.Series | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function keeping ``path/rows``: bars and indicators, as ``indicator_set`` gives over all of them.

    Batches may bring bars in any order. A bar that is there already is replaced; of equal keys in one batch the largest
    values count. Bars without ticker, frequency or time are skipped and counted. ``path/commits`` lists the batches
    that have ended with their rows, late rows (not newer than the last stored bar of their series), stored rows
    corrected because of them, and skipped rows. A batch found there changes nothing; one cut short is done again and
    lists what its first attempt would have. ``period`` is the width of a partition.
    """
    if "rsi_14" in names:
        raise ValueError("rsi_14 has no bound on the rows it needs: movements may be missing for any number of rows")
    series = series or S.bars()
    history = max(I.lookback(n) for n in names) + 1
    rows, parts = f"{path}/rows", f"{path}/parts"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entry, pending = f"{path}/commits/batch_id={batch_id}", f"{path}/pending/batch_id={batch_id}"
        if table_exists(spark, entry):
            return
        scratch = work_dir(spark, "indicators")

        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{scratch}/{name}")
            return spark.read.schema(df.schema).parquet(f"{scratch}/{name}")

        bars = finite_columns(batch.select(*KEYS, "ts", *[F.col(c).cast("double").alias(c) for c in VALUES]), VALUES)
        whole = F.col("ticker").isNotNull() & F.col("frequency").isNotNull() & F.col("ts").isNotNull()
        fresh = keep(dedupe(bars.where(whole), [*KEYS, "ts"], VALUES).withColumn("part", _period(period)), "fresh")
        known = table_exists(spark, rows)
        stored = spark.read.parquet(rows) if known else None
        starts = keep(_starts(fresh, spark.read.parquet(parts) if table_exists(spark, parts) else None, history), "starts")
        low = starts.agg(F.min("__from")).first()[0] or 0
        plain = [*KEYS, "ts", *VALUES, "part"]
        own = "obv" if "obv" in names else "CAST(NULL AS DOUBLE)"
        context = fresh.select(*plain, F.lit(True).alias("__due"), F.lit(None).cast("double").alias("__obv"))
        corrected = spark.createDataFrame([], fresh.schema)
        if stored is not None:
            # The bound is a literal, so that the scan opens no older periods.
            read = stored.where(F.col("part") >= F.lit(low)).join(starts, KEYS).where(F.col("part") >= F.col("__from"))
            kept = read.join(fresh.select(*KEYS, "ts"), [*KEYS, "ts"], "left_anti")
            corrected = kept.where(F.col("ts") > F.col("__start"))
            context = context.unionByName(kept.select(*plain, (F.col("ts") > F.col("__start")).alias("__due"), F.expr(own).alias("__obv")))
        if not table_exists(spark, pending):
            late = fresh.join(starts, KEYS).where(F.col("ts") <= F.col("__last"))
            counts = fresh.agg(F.count("*").alias("n_rows"))
            for name, df in (("n_late", late), ("n_corrected", corrected), ("n_skipped", bars.where(~whole))):
                counts = counts.withColumn(name, df.agg(F.count("*")).scalar())
            counts.write.mode("overwrite").parquet(pending)
        if not fresh.isEmpty():
            done = keep(I.indicator_set(keep(context, "context"), names, series), "done")
            due = done.where("__due")
            if "obv" in names:
                # On-balance volume of the last bar before the start, as stored and as counted from where reading began.
                carried = done.where("NOT __due").groupBy(*KEYS).agg(
                    F.max_by(F.col("__obv") - F.col("obv"), "ts").alias("__carried"))
                due = due.join(carried, KEYS, "left").withColumn("obv", F.col("obv") + F.coalesce("__carried", F.lit(0.0)))
            out = keep(due.select(*[c for c in plain if c != "part"], *names, "part"), "out")
            if stored is None:
                out.repartitionByRange("part", *KEYS, "ts").write.mode("overwrite").partitionBy("part").parquet(rows)
            else:
                bound = starts.select(*KEYS, "__start")
                rewrite_partitions(
                    spark, rows, out, "part", lambda old: old.join(bound, KEYS, "left").where(
                        F.col("__start").isNull() | (F.col("ts") < F.col("__start"))).select(*out.columns).unionByName(out))
            lowest = fresh.agg(F.min("part")).first()[0]
            spark.catalog.refreshByPath(rows)
            summary = spark.read.parquet(rows).where(F.col("part") >= F.lit(lowest)).groupBy(*KEYS, "part").agg(
                F.count("close").alias("n_known"), F.max("ts").alias("last_ts"))
            summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(parts)
        spark.read.schema(LEDGER).parquet(pending).write.mode("overwrite").parquet(entry)
        delete_folder(spark, scratch)
        delete_folder(spark, pending)

    return run


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """``batch_id`` and the row counts of the batches that have ended."""
    return spark.read.schema(f"{LEDGER}, batch_id long").parquet(f"{path}/commits")
