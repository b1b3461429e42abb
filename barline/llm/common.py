"""What the operators share: inputs made safe, shared folders, and text as byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text a kernel holds at once; its working arrays take some 60 times as much.
BLOCK_BYTES = 1 << 20


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null becomes empty) and the columns asked for; all others are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id falls into fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)), F.lit(0)).cast("int")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the working directory that later steps no longer read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes (one row may be longer): first, end, bytes, row offsets."""
    array = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        width = np.int64
    else:
        width = np.int32
    _, offset_buffer, data_buffer = array.buffers()
    n = len(array)
    if n == 0:
        return
    offsets = np.frombuffer(offset_buffer, width)[array.offset:array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def as_block(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Several byte strings end to end, and their offsets."""
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return np.frombuffer(b"".join(rows), np.uint8), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next block."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        known = np.ones(size, np.uint64)
        known[1:] = base
        np.multiply.accumulate(known, out=known)
        _POWERS[int(base)] = known
    return known[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sum of (byte + 1) * base**position, modulo 2**64; one longer than ``data``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent polynomial hash of every span."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), BASE_INVERSE)[start]


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of non-space bytes; runs never cross rows."""
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the row of every word."""
    start, end, row = words(data, offsets, space)
    return mix(span_hashes(prefix_hashes(data), start, end) + (end - start).astype(np.uint64)), row


def shingles(hashes: np.ndarray, row: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``width`` words; a row with fewer words is one shingle, one with none has none."""
    n = len(hashes)
    if n == 0:
        return hashes, row
    first = np.searchsorted(row, row, "left")
    last = np.searchsorted(row, row, "right")
    here = np.arange(n)
    whole = here + width <= last
    short = (last - first < width) & (here == first)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        valid = here + k < last
        out += np.where(valid, hashes[np.minimum(here + k, n - 1)], np.uint64(k + 1)) * powers(width + 1)[k + 1]
    keep = whole | short
    return mix(out[keep]), row[keep]
