"""Token counts by a separator scan over flat, unindexed token files.

A token file is a run of little-endian 16-bit ids without any index: documents one after the other, each closed by
the id 0. Our writer stores vocabulary ids plus one, opens every document with ``ID_TOKENS`` ids that spell its
number in base 32768, and fills the end of a file up to a whole block with the id 65535.

Counting reads the files in blocks of ``BLOCK`` bytes, splits of a file in parallel. A task finds the separators of
each block with one vectorised comparison, carries an open document from block to block, and hands on what lies
before its first and after its last separator. A prefix scan over those rows, one a task, stitches the documents
that cross tasks, however many tasks one document spans.

Rules: null text is empty and counts 0; a null id comes back null; repeated rows are counted each for itself. A last
document without a separator counts as a document. A file's length must be a multiple of ``BLOCK``; a file of any
other length fails the read rather than lose its end. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm import byte_bpe
from barline.llm import common as C
from barline.session import settle, work_dir

BLOCK = 1 << 16
ID_TOKENS, DIGIT_BITS, NO_ID, PAD, SEPARATOR = 5, 15, 40_000, 65_535, "\0\0"


def _spelled(doc_id) -> np.ndarray:
    """The tokens that open a document."""
    if doc_id is None or doc_id != doc_id:
        return np.full(ID_TOKENS, NO_ID, "<u2")
    number = int(doc_id) & (1 << 64) - 1
    return np.array([(number >> DIGIT_BITS * k & (1 << DIGIT_BITS) - 1) + 1 for k in range(ID_TOKENS)], "<u2")


def _spelling(head: Column) -> Column:
    """The document's number from its first tokens."""
    number = F.lit(0).cast("long")
    for k in range(ID_TOKENS):
        number = number.bitwiseOR(F.shiftleft((head[k] - 1).cast("long"), DIGIT_BITS * k))
    return F.when(head[0] != NO_ID, number)


def write(docs: DataFrame, path: str, vocabulary: str = byte_bpe.VOCABULARY) -> None:
    """Token files of all documents under ``path``, one a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 0
        for frame in frames:
            for part in range(0, len(frame), 256):
                piece = frame.iloc[part:part + 256]
                rows = [np.concatenate([_spelled(i), (byte_bpe.encode(t, vocabulary) + 1).astype("<u2")]).tobytes()
                        for i, t in zip(piece["doc_id"].astype(object), piece["text"])]
                size += sum(len(r) + 2 for r in rows)
                yield pd.DataFrame({"run": rows})
        if size % BLOCK:
            yield pd.DataFrame({"run": [b"\xff" * (BLOCK - size % BLOCK - 2)]})

    source = C.texts(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    # The text sink writes bytes as they are and the separator after every row.
    source.mapInPandas(run, "run binary").select(F.col("run").cast("string").alias("value")).write.option(
        "lineSep", SEPARATOR).text(path)


def _scan(part: int, blocks: Iterator[bytes]) -> Iterator[tuple]:
    """Rows (task, kind, tokens, first tokens): kind 0 a document, 1 what precedes the first separator, 2 what
    follows the last, 3 a task without separator."""
    length, head, seen = 0, [], False
    for block in blocks:
        ids = np.frombuffer(block, "<u2")
        ends = np.flatnonzero(ids == 0)
        if len(ends) == 0:
            head = head + ids[:ID_TOKENS - len(head)].tolist()
            length += len(ids)
            continue
        head = head + ids[:min(int(ends[0]), ID_TOKENS - len(head))].tolist()
        yield part, 0 if seen else 1, length + int(ends[0]), head
        seen = True
        starts, sizes = ends[:-1] + 1, np.diff(ends) - 1
        reach = np.minimum(starts[:, None] + np.arange(ID_TOKENS), len(ids) - 1)
        for n, first in zip(sizes.tolist(), ids[reach].tolist()):
            yield part, 0, n, first[:n]
        rest = ids[ends[-1] + 1:]
        length, head = len(rest), rest[:ID_TOKENS].tolist()
    yield part, 2 if seen else 3, length, head


def read(spark: SparkSession, path: str) -> DataFrame:
    """``n_tokens`` (ids before the separator) and ``head`` (the first ones) of every document of the files."""
    blocks = spark.sparkContext.binaryRecords(path, BLOCK)
    rows = settle(spark.createDataFrame(blocks.mapPartitionsWithIndex(_scan), "part int, kind int, n long, head array<int>"),
                  "token-scan")
    inner = rows.where("kind = 0").select(F.col("n").alias("n_tokens"), "head")
    # One row a task from here on.
    task = rows.where("kind > 0").groupBy("part").agg(
        *(F.max(F.when(F.col("kind") == k, F.col("n"))).alias(f"n{k}") for k in (1, 2, 3)),
        *(F.max(F.when(F.col("kind") == k, F.col("head"))).alias(f"h{k}") for k in (1, 2, 3)))
    order = Window.orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opening = F.coalesce("h1", "h3")
    scanned = task.select(
        "*", F.coalesce(F.sum("n3").over(order), F.lit(0)).alias("passed"), F.lead(opening).over(order).alias("after"),
        F.max("part").over(Window.partitionBy()).alias("last_part"))
    carry = F.when(F.col("n2").isNotNull(), F.struct(
        (F.col("n2") - F.col("passed")).alias("n"), F.concat("h2", F.coalesce("after", F.array().cast("array<int>"))).alias("head")))
    scanned = scanned.withColumn("carry", carry)
    scanned = scanned.select(
        "*", F.last("carry", True).over(before).alias("open"),
        F.first(opening).over(before).alias("opening"), F.last("carry", True).over(order).alias("open_end"),
        F.first(opening).over(order).alias("opening_end"))
    total, none = F.col("passed") - F.coalesce("n3", F.lit(0)), F.array().cast("array<int>")
    crossing = scanned.where("n1 is not null").select(
        (F.coalesce("open.n", F.lit(0)) + total + F.col("n1")).alias("n_tokens"),
        F.when(F.col("open").isNotNull(), F.col("open.head")).otherwise(F.coalesce(F.col("opening"), F.col("h1"))).alias("head"))
    unended = scanned.where("part = last_part").select(
        (F.coalesce("open_end.n", F.lit(0)) + F.col("passed")).alias("n_tokens"),
        F.coalesce("open_end.head", "opening_end", none).alias("head")).where("n_tokens > 0")
    return inner.unionByName(crossing).unionByName(unended).select(
        "n_tokens", F.slice("head", 1, ID_TOKENS).alias("head"))


def count(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` of every document that :func:`write` stored under ``path``."""
    return (read(spark, path).where(F.coalesce(F.col("head")[0] != PAD, F.lit(False)))
            .select(_spelling(F.col("head")).alias("doc_id"), (F.col("n_tokens") - ID_TOKENS).alias("n_tokens")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    counts = count(spark, path)  # the files have been scanned when this returns
    C.drop_folder(spark, path)
    return counts
