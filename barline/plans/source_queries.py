"""Registered queries: scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.text import vendor_symbol
from barline.operators import merge as M
from barline.operators import sentiment
from barline.plans import oracle as O
from barline.plans.registry import query
from barline.session import work_dir
from barline.sources import fixtures as X
from barline.sources import readers, writers

TOPICS = ["purchase", "click"]
_BAR_COLUMNS = ["open", "high", "low", "close", "volume", "transactions"]
_ALL_BARS = "SELECT ticker, dt, round(close, 6) AS close, volume, transactions FROM bars"


def _plain(df: DataFrame) -> DataFrame:
    return df.select("ticker", "dt", F.round("close", 6).alias("close"), "volume", "transactions")


@query("scan_bars", O.with_(O.BARS) + """SELECT ticker, dt, frequency, open, high, low, close FROM bars
 WHERE ticker IN ('AF', 'NF', 'RF') AND dt BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND frequency = 'daily'""")
def scan_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.scan_bars(X.bars(spark, sf_dir), X.BASKET, "1996-01-01", "1998-12-31", "daily",
                             ["open", "high", "low", "close"])


@query("scan_articles", O.with_(O.ARTICLES) + """SELECT article_id, ts, v2tone, source FROM articles
 WHERE dt BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
   AND CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) BETWEEN 20240105000000 AND 20240120235959""")
def scan_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.articles(spark, sf_dir).withColumn("compact", F.date_format("ts", "yyyyMMddHHmmss").cast("long"))
    return readers.scan_articles(rows, "2024-01-05", "2024-01-20", "compact").select("article_id", "ts", "v2tone", "source")


@query("scan_files", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = X.table(spark, sf_dir, "orders")
    path = work_dir(spark, "scan_files")
    orders.write.option("header", True).csv(path)
    features = readers.load(spark, path, "csv", ["o_totalprice"], orders.schema, keep=["o_totalprice"])
    same = readers.load(spark, f"{sf_dir}/orders.parquet", "parquet", ["o_totalprice"], keep=["o_totalprice"])
    return features.select(same.columns)


@query("scan_template", O.with_(O.BARS) + """SELECT ticker, dt, close FROM bars
 WHERE dt >= DATE '1999-01-01' AND dt < DATE '2000-01-01'""")
def scan_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.scan_template(
        spark, "SELECT ticker, dt, close FROM {bars} WHERE dt >= CAST(:start AS DATE) AND dt < CAST(:end AS DATE)",
        {"start": "1999-01-01", "end": "2000-01-01"}, bars=X.bars(spark, sf_dir))


_LANDED = O.with_(O.BARS) + """SELECT ticker, ts, dt, frequency, open, high, low, close, volume,
 round(vwap * volume, 2) AS notional, transactions FROM bars"""


def _landed(df: DataFrame) -> DataFrame:
    return df.select("ticker", "ts", "dt", "frequency", "open", "high", "low", "close", "volume",
                     F.round(F.col("vwap") * F.col("volume"), 2).alias("notional"), "transactions")


@query("landed_json_bars", _LANDED)
def landed_json_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "landed")
    readers.vendor_pages(X.bars(spark, sf_dir)).write.text(path)
    return _landed(readers.read_landed(spark, path))


@query("json_landing", _LANDED)
def json_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(readers.parse_landed(readers.vendor_pages(X.bars(spark, sf_dir)), "value"))


@query("symbol_normalise", """WITH s AS (SELECT c_custkey,
   CASE WHEN mod(c_nationkey, 2) = 0 THEN concat(c_mktsegment, '-USD') ELSE c_mktsegment END AS symbol FROM customer)
 SELECT c_custkey, symbol, CASE WHEN symbol LIKE '%-USD' THEN concat('X:', replace(symbol, '-USD', 'USD')) ELSE symbol END
   AS vendor_symbol FROM s""")
def symbol_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    symbol = F.when(F.col("c_nationkey") % 2 == 0, F.concat(segment, F.lit("-USD"))).otherwise(segment)
    return X.table(spark, sf_dir, "customer").select("c_custkey", symbol.alias("symbol")).withColumn(
        "vendor_symbol", vendor_symbol(F.col("symbol")))


@query("write_append", O.with_(O.BARS) + _ALL_BARS)
def write_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, path = X.bars(spark, sf_dir), work_dir(spark, "append")
    writers.write_bars(bars.where("dt < DATE '1999-01-01'"), path)
    writers.write_bars(bars.where("dt >= DATE '1999-01-01'"), path)
    return _plain(writers.read_table(spark, path))


@query("write_truncate", O.with_(O.BARS) + _ALL_BARS + " WHERE dt >= DATE '1999-01-01'")
def write_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, path = X.bars(spark, sf_dir), work_dir(spark, "truncate")
    writers.write_truncate(bars.where("dt < DATE '1999-01-01'"), path, sort=["ticker", "ts"])
    writers.write_truncate(bars.where("dt >= DATE '1999-01-01'"), path, sort=["ticker", "ts"])
    return _plain(spark.read.parquet(path))


@query("export_parquet_csv", O.with_(O.BARS) + """SELECT ticker, dt, round(close, 6) AS close_parquet, round(close, 6) AS close_csv,
 round(vwap * volume, 2) AS notional_csv FROM bars""")
def export_parquet_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_dir(spark, "export")
    bars = X.bars(spark, sf_dir)
    writers.export_parquet_csv(bars, base)
    pq = spark.read.parquet(f"{base}/parquet").select("ticker", "dt", F.round("close", 6).alias("close_parquet"))
    cs = spark.read.schema(bars.schema).option("header", True).csv(f"{base}/csv").select(
        "ticker", "dt", F.round("close", 6).alias("close_csv"), F.round(F.col("vwap") * F.col("volume"), 2).alias("notional_csv"))
    return pq.join(cs, ["ticker", "dt"])


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "orders").groupBy(
        F.concat_ws("/", "o_orderpriority", F.year("o_orderdate").cast("string")).alias("version")).agg(
        F.min(F.col("o_orderdate").cast("date")).alias("created"), F.count("*").alias("n_samples"))


@query("dataset_registry", """WITH r AS (SELECT concat(o_orderpriority, '/', CAST(year(o_orderdate) AS VARCHAR)) AS version,
   min(CAST(o_orderdate AS DATE)) AS created, count(*) AS n_samples FROM orders GROUP BY 1)
 SELECT version, created, CASE WHEN created >= DATE '2000-01-01' THEN n_samples + 1000 ELSE n_samples END AS n_samples
 FROM r WHERE NOT (created < DATE '1996-01-01')""")
def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_rows = _registry(spark, sf_dir)
    base = all_rows.where("created < DATE '2001-01-01'")
    newer = all_rows.where("created >= DATE '2000-01-01'").withColumn("n_samples", F.col("n_samples") + 1000)
    return M.registry_delete(M.registry_upsert(base, newer), all_rows.where("created < DATE '1996-01-01'"))


@query("load_lineage", O.with_(O.PARSED) + """, b AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, count(*) AS n FROM parsed
   WHERE v2locations LIKE '%#US#%' AND (contains(v2themes, 'PURCHASE') OR contains(v2themes, 'CLICK')) GROUP BY 1)
 SELECT 'q1' AS query_id, 'shop' AS topic_group_id, min(CAST(ts AS DATE)) AS start_date, max(CAST(ts AS DATE)) AS end_date,
   'purchase,click' AS topics, count(*) AS num_rows, CAST(sum(n) AS BIGINT) AS num_articles, '15m' AS frequency FROM b""")
def load_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentiment.sentiment_15m(sentiment.select_articles(X.articles(spark, sf_dir), TOPICS))
    return writers.load_lineage(rows, "q1", "shop", TOPICS, "15m").drop("load_timestamp").withColumn(
        "topics", F.array_join("topics", ","))


_SHOP = """b AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, count(*) AS n FROM parsed
   WHERE v2locations LIKE '%#US#%' AND (contains(v2themes, 'PURCHASE') OR contains(v2themes, 'CLICK')) GROUP BY 1)"""


@query("lineage_appended", O.with_(O.PARSED, _SHOP) + """SELECT 'q1' AS query_id, 'shop' AS topic_group_id, min(CAST(ts AS DATE)) AS start_date,
   max(CAST(ts AS DATE)) AS end_date, 'purchase,click' AS topics, count(*) AS num_rows, CAST(sum(n) AS BIGINT) AS num_articles, '15m' AS frequency,
   'first load' AS notes, '{"frequency": "15m", "topics": ["purchase", "click"]}' AS config, count(*) AS stored_rows FROM b""")
def lineage_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads with their metadata appended; then one topic group is deleted from both tables."""
    base, parts = work_dir(spark, "loads"), []
    for query_id, group, topics, notes in (("q1", "shop", TOPICS, "first load"), ("q2", "other", ["view", "signup"], None)):
        rows = sentiment.sentiment_15m(sentiment.select_articles(X.articles(spark, sf_dir), topics))
        rows.withColumn("topic_group_id", F.lit(group)).write.mode("append").partitionBy("topic_group_id").parquet(f"{base}/sentiment")
        told = writers.load_lineage(rows, query_id, group, topics, "15m")
        writers.append_lineage(spark, f"{base}/metadata", told, {"topics": list(topics), "frequency": "15m"}, notes)
        parts.append(group)
    writers.delete_group(spark, f"{base}/sentiment", f"{base}/metadata", parts[-1])
    stored = writers.read_table(spark, f"{base}/sentiment").groupBy("topic_group_id").agg(F.count("*").alias("stored_rows"))
    return writers.read_table(spark, f"{base}/metadata").join(stored, "topic_group_id", "full").drop("load_timestamp").withColumn(
        "topics", F.array_join("topics", ","))


@query("scan_articles_by_day", O.with_(O.ARTICLES) + """SELECT article_id, ts, source FROM articles
 WHERE dt BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' AND v2locations LIKE '%#US#%'""")
def scan_articles_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles stored by day: a range of days opens those days' folders only."""
    path = work_dir(spark, "articles")
    writers.write_articles(X.articles(spark, sf_dir), path)
    return readers.scan_article_days(spark, path, "2024-01-05", "2024-01-09").where("v2locations LIKE '%#US#%'").select("article_id", "ts", "source")
