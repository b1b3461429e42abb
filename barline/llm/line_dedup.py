"""Line deduplication by site-relative frequency.

A host's pages that hold a line, divided by all pages of the host, is the line's ratio. A line whose ratio exceeds
``ratio`` and that is on at least ``min_pages`` pages of the host is boilerplate there and is dropped from all of them.

Rules: lines end at a line feed; null text is one empty line; empty lines are kept and never counted. A page counts
a line once, however often it repeats it. A null host is a host of its own, the empty name. Rows with the same id
are pages of their own. Extra columns pass through untouched.

Lines are counted by digest, combined before the shuffle, so a common line or a hot host costs one row a task. At
most 1/ratio times the mean number of lines a page are boilerplate at a host: they form one short array a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import settle

RATIO, MIN_PAGES = 0.05, 5
BROADCAST_BYTES, SALTS = 32 << 20, 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host``, ``bad``: digests of each host's boilerplate lines."""
    named = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    totals = named.groupBy("host").agg(F.count("*").alias("pages"))
    lines = (named.select("host", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line"))
             .where("line <> ''").select("host", _digest(F.col("line")).alias("line"))
             .groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    return (lines.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
            .groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("bad")))


def drop_boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES,
                     counts: bool = True) -> DataFrame:
    """``pages`` with the lines removed; with ``counts`` also ``n_lines``, ``n_dropped`` (both longs) at the end, in
    place of columns that have these names.

    The hosts' arrays are written and measured. Up to ``BROADCAST_BYTES`` they are sent to all tasks and no text is
    shuffled; beyond that each array is copied ``SALTS`` times, so that a hot host's pages spread over as many tasks.
    """
    bad = settle(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    measured = bad.agg(F.sum(F.size("bad") * 40 + F.octet_length("host") + 64)).first()[0] or 0
    # A page's own columns travel in one struct, so that no name can clash.
    named = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"),
                         F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"))
    if measured <= BROADCAST_BYTES:
        found = named.join(F.broadcast(bad), "host", "left")
    else:
        salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = (named.withColumn("salt", F.pmod(F.xxhash64(F.col("text")), F.lit(SALTS)).cast("int"))
                 .join(salted, ["host", "salt"], "left"))
    kept = F.when(F.col("bad").isNull(), _lines(F.col("text"))).otherwise(
        F.filter(_lines(F.col("text")), lambda line: (line == "") | ~F.array_contains(F.col("bad"), _digest(line))))
    found = found.withColumn("kept", kept)
    left_out = {"n_lines", "n_dropped"} if counts else set()
    out = [F.when(F.col("text").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias(text)
           if c == text else F.col(f"row.`{c}`").alias(c) for c in pages.columns if c not in left_out]
    n = F.size(_lines(F.col("text"))).cast("long")
    return found.select(*out, *([n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped")] if counts else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their source as host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return drop_boilerplate(docs, "source", "text").select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""WITH p AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines,
   coalesce(source, '') AS host FROM documents),
 l AS (SELECT DISTINCT r, host, unnest(lines) AS line FROM p),
 t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
 b AS (SELECT l.host, list(DISTINCT line) AS bad FROM (SELECT host, line, count(*) AS n FROM l WHERE line <> ''
   GROUP BY host, line) l JOIN t ON l.host = t.host WHERE n >= {MIN_PAGES} AND n > CAST({RATIO} AS DOUBLE) * pages GROUP BY l.host),
 k AS (SELECT doc_id, lines, list_filter(lines, lambda x: bad IS NULL OR x = '' OR NOT list_contains(bad, x)) AS kept
   FROM p LEFT JOIN b ON p.host = b.host)
 SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
   sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k"""
