"""Document fingerprints by one-permutation MinHash.

Shingles of five words are hashed once. The top bits choose one of 256 bins, the rest is the value; a bin keeps
its smallest value. Empty bins borrow from the first full bin on a fixed random walk of their own (optimal
densification), and the low 8 bits of every bin are stored, as lower-case hex. The likeness of two fingerprints
is the share of equal bins, corrected for low bits that agree by chance.

Rules: null text is empty; a text without words has the empty fingerprint, which is 1 like another empty one
and 0 like any other; a text of fewer than five words is one shingle. Equal texts have equal fingerprints.
Extra columns are ignored. Repeated ids are documents of their own, ordered by their text; null ids come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm import common as C
from barline.session import settle

BIN_BITS, BINS, LOW_BITS = 8, 256, 8
_WALKS = np.argsort(np.random.default_rng(20240607).random((BINS, BINS)), axis=1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of the bins of every row of a block, and which rows have words."""
    rows = len(offsets) - 1
    hashes, row = C.shingles(*C.word_hashes(data, offsets))
    bins = np.full(rows * BINS, _FULL)
    np.minimum.at(bins, row * BINS + (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64), hashes << np.uint64(BIN_BITS))
    bins = bins.reshape(rows, BINS)
    full = bins != _FULL
    some = full.any(axis=1)
    open_row, open_bin = np.nonzero(~full & some[:, None])
    step = 0
    while len(open_row):
        source = _WALKS[open_bin, step]
        found = full[open_row, source]
        bins[open_row[found], open_bin[found]] = bins[open_row[found], source[found]]
        open_row, open_bin = open_row[~found], open_bin[~found]
        step += 1
    return (C.mix(bins) & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8), some


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated resemblance, row by row."""
    chance = 1.0 / (1 << LOW_BITS)
    estimate = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, estimate, (~some_a & ~some_b).astype(float))


def _packed(marks: np.ndarray, some: np.ndarray) -> list[bytes]:
    return [m.tobytes() if s else b"" for m, s in zip(marks, some)]


def _as_hex(*columns: str) -> dict[str, Column]:
    return {c: F.lower(F.hex(c)) for c in columns}


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, offsets in C.text_blocks(batch):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), pa.array(_packed(*fingerprints(data, offsets)), pa.binary())],
                    ["doc_id", "fingerprint"])

    return C.texts(docs).mapInArrow(run, "doc_id long, fingerprint binary").withColumns(_as_hex("fingerprint"))


_RESULT = ("doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
           "near_edited double, near_next double, ")
_SCHEMA = _RESULT + "edge int, text string, part int"


def _compare(ids: list, own: list[str], following: list[str]) -> dict[str, list]:
    """Result columns of documents and the texts that follow them, in blocks."""
    out: dict[str, list] = {k: [] for k in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                            "near_edited", "near_next")}
    sizes, first = np.cumsum([len(t) for t in own]), 0
    while first < len(own):
        base = sizes[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(sizes, base + C.BLOCK_BYTES // 4, "right")))
        a, b = own[first:end], following[first:end]
        edited = [(t[:len(t) - len(t) // 3] + u[:len(t) // 3]).encode() for t, u in zip(a, b)]
        of_own = fingerprints(*C.as_block([t.encode() for t in a]))
        of_edited = fingerprints(*C.as_block(edited))
        of_next = fingerprints(*C.as_block([t.encode() for t in b]))
        out["n_chars"] += [len(t) for t in a]
        out["edited_sha256"] += [hashlib.sha256(t).digest() for t in edited]
        out["fingerprint"] += _packed(*of_own)
        out["edited_fingerprint"] += _packed(*of_edited)
        out["near_edited"] += likeness(*of_own, *of_edited).tolist()
        out["near_next"] += likeness(*of_own, *of_next).tolist()
        first = end
    return {"doc_id": ids, **out}


def _sorted_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare every row with the next of its partition; the first and the last row go on as edges."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()),
                        ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()),
                        ("near_next", pa.float64()), ("edge", pa.int32()), ("text", pa.string()), ("part", pa.int32())])
    part_id = TaskContext.get().partitionId()

    def edge(kind: int, row: tuple) -> pa.RecordBatch:
        frame = {name: [None] for name in schema.names} | {"doc_id": [row[0]], "edge": [kind], "text": [row[1]], "part": [part_id]}
        return pa.RecordBatch.from_pydict(frame, schema)

    held = None
    for batch in batches:
        for part in range(0, batch.num_rows, 512):
            piece = batch.slice(part, 512).to_pydict()
            rows = list(zip(piece["doc_id"], piece["text"]))
            if held is None:
                yield edge(1, rows[0])
            else:
                rows.insert(0, held)
            held = rows[-1]
            if len(rows) > 1:
                done = _compare([r[0] for r in rows[:-1]], [r[1] for r in rows[:-1]], [r[1] for r in rows[1:]])
                none = [None] * (len(rows) - 1)
                yield pa.RecordBatch.from_pydict(done | {"edge": [0] * len(none), "text": none, "part": none}, schema)
    if held is not None:
        yield edge(2, held)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likenesses.

    The texts are dealt out by ranges of descending id once. A task compares its rows with their followers and
    hands on its first and last row; those two rows a task are paired afterwards.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    spread = C.texts(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    done = settle(spread.mapInArrow(_sorted_part, _SCHEMA), "fingerprints")
    columns = [c.strip().split(" ")[0] for c in _RESULT.strip(", ").split(",")]
    inner = done.where("edge = 0").select(*columns)
    edges = settle(done.where("edge > 0").select("doc_id", "part", "edge", "text"), "edges")
    # One short row a task: the order of tasks is the order of ids.
    first = edges.where("edge = 1").select("part")
    following = first.select("part", F.lead("part").over(Window.orderBy("part")).alias("after"))
    top = first.agg(F.min("part").alias("top"), F.max("part").alias("part"))
    following = following.join(top, "part", "left").select("part", F.coalesce("after", "top").alias("after"))
    pairs = (edges.where("edge = 2").select("doc_id", "text", "part").join(following, "part")
             .join(edges.where("edge = 1").select(F.col("part").alias("after"), F.col("text").alias("next_text")), "after")
             .select("doc_id", "text", "next_text"))

    def stitched(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame(_compare(frame["doc_id"].tolist(), frame["text"].tolist(), frame["next_text"].tolist()))

    return (inner.unionByName(pairs.mapInPandas(stitched, _RESULT.strip(", ")))
            .withColumns(_as_hex("edited_sha256", "fingerprint", "edited_fingerprint")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
