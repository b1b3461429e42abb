"""Language-model scoring by deleted interpolation.

The model is P(w|v) = a(v) c(vw)/c(v) + (1 - a(v)) P(w), with P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). The weight a
depends on the frequency class of the context (powers of two of c(v)). Weights are learned by expectation
maximisation: fold 1 of the training documents is held out, its tokens' ratios of the two estimates under the
counts of the other folds are gathered as histograms over all of them, and the weights that suit them best are
used with the counts of all training documents.

Documents are read in chunks. A chunk sends its distinct n-grams, as sorted hashes packed by bucket, to the
buckets that sum them; a bucket sends the sums back to the chunks that asked; a chunk then holds the counts of all its
tokens. Everything is keyed by 64-bit hashes, so neither a vocabulary nor a table of n-grams is ever gathered, and
a frequent n-gram costs a bucket one entry a chunk. There is a bucket for every ``BUCKET_BYTES`` of text, and as many
partitions, so that what a task holds does not follow the input. A text is never split: a task needs memory for its
longest text.

Rules: null text is empty and has one token, its end. A context is the word before, or the start, whose frequency is
the number of training documents. Contexts never seen have weight 0. Extra columns are ignored; repeated rows count
as documents of their own; a null id is in fold 0. Without training documents all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import common as C
from barline.session import settle

FOLDS, HELD_FOLD, ADD = 10, 1, 0.1
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20  # of text a bucket; its messages take some 1.7 times as much
CLASSES, BINS, BIN_STEP = 48, 512, 0.25  # histogram bins are quarter powers of two
_END, _PAIR = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xD6E8FEB86659FD93)
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_ROW = "dest long, chunk long, kind int, bucket int, payload binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte planes apart, compressed."""
    packer, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros((a.itemsize, 0), np.uint8)
        body = packer.compress(np.ascontiguousarray(planes).tobytes())
        out.append(len(body).to_bytes(8, "little") + len(a).to_bytes(8, "little") + a.dtype.str.encode().ljust(8) + body)
    return b"".join(out)


def _unpack(packed: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(packed):
        size, n = int.from_bytes(packed[at:at + 8], "little"), int.from_bytes(packed[at + 8:at + 16], "little")
        kind = np.dtype(packed[at + 16:at + 24].decode().strip())
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[at + 24:at + 24 + size], n * kind.itemsize or 1), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += 24 + size
    return out


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram and bigram keys of every token, and the first token of each text.

    Unigram keys are even and have 63 bits; bigram keys have 56 bits and end in a one.
    """
    hashes, rows = [], []
    low, texts = 0, len(offsets) - 1
    while low < texts:  # in blocks, for the working arrays of single bytes
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + C.BLOCK_BYTES, "right")) - 1)
        part = _SMALL[data[offsets[low]:offsets[high]]]
        h, r = C.word_hashes(part, offsets[low:high + 1] - offsets[low])
        hashes.append(h)
        rows.append(r + low)
        low = high
    word, row = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hashes, rows))
    row = row.astype(np.int64)
    first = np.searchsorted(row, np.arange(texts + 1)) + np.arange(texts + 1)
    tokens = np.full(len(word) + texts, _END)
    tokens[np.arange(len(word)) + row] = word
    tokens &= ~np.uint64(1)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = _END & ~np.uint64(1)
    return tokens, C.mix(before * _PAIR + tokens) & ~np.uint64(0xFF) | np.uint64(1), first


def _distinct(keys: np.ndarray, training: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each occurs in training and in held-out tokens."""
    order = np.argsort(keys)
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if len(starts) == 0:
        return ranked, np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    return (ranked[starts], np.add.reduceat(training[order].astype(np.uint32), starts),
            np.add.reduceat(held[order].astype(np.uint32), starts))


def _ask(buckets: int):
    """Map side: each chunk's texts, addressed to itself, and its n-grams, addressed to the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, folds = batch.column(0), np.asarray(batch.column(2))
            for a, b, data, offsets in C.text_blocks(batch, limit=CHUNK_BYTES):
                chunk, serial = (task << 32) + serial, serial + 1
                one, two, first = _keys(data, offsets)
                fold = np.repeat(folds[a:b], np.diff(first))
                keys, train, held = _distinct(np.concatenate([one, two]), np.tile(fold != 0, 2), np.tile(fold == HELD_FOLD, 2))
                # Keys are sorted, so a bucket (a range of the top 32 bits) is a slice.
                cuts = np.searchsorted(keys >> np.uint64(32), np.array([(k << 32) // buckets for k in range(buckets + 1)], np.uint64))
                known = np.asarray(ids.slice(a, b - a).is_valid())
                number = np.asarray(ids.slice(a, b - a).fill_null(0))
                text = zstandard.ZstdCompressor(level=6).compress(data.tobytes())
                own = _pack(number, known.astype(np.uint8), folds[a:b].astype(np.uint8), offsets, np.frombuffer(text, np.uint8))
                rows = [(-1 - chunk, chunk, 0, 0, own)]
                for k in range(buckets):
                    part = slice(cuts[k], cuts[k + 1])
                    if part.stop > part.start:
                        steps = np.diff(keys[part], prepend=np.uint64(0))
                        rows.append((k, chunk, 1, k, _pack(steps, train[part], held[part])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()),
                     pa.array([r[4] for r in rows], pa.binary())], ["dest", "chunk", "kind", "bucket", "payload"])

    return run


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """A bucket's sums for each chunk that asked, and its share of N and V. A chunk's own rows pass through."""
    if frame["kind"].iloc[0] == 0:
        return frame.drop(columns="slot")
    asked = [_unpack(p) for p in frame["payload"]]
    sizes = [len(a[0]) for a in asked]
    keys = np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked])
    distinct, at = np.unique(keys, return_inverse=True)
    train = np.bincount(at, np.concatenate([a[1] for a in asked]), len(distinct)).astype(np.uint64)
    held = np.bincount(at, np.concatenate([a[2] for a in asked]), len(distinct)).astype(np.uint64)
    unigram = (distinct & np.uint64(1)) == 0
    replies = [_pack(train[part], held[part]) for part in np.split(at, np.cumsum(sizes)[:-1])]
    total = np.array([train[unigram].sum(), (train[unigram] > 0).sum()], np.uint64)
    out = frame.assign(kind=2, payload=replies, dest=-1)
    return pd.concat([out, pd.DataFrame({"dest": [-1], "chunk": [-1], "kind": [3], "bucket": frame["bucket"].iloc[:1],
                                         "payload": [_pack(total)]})])[["dest", "chunk", "kind", "bucket", "payload"]]


_COUNTED = "kind int, total long, kinds long, payload binary"


def _classes(context: np.ndarray) -> np.ndarray:
    return np.frexp(context.astype(np.float64))[1].astype(np.int64)  # 0 for a context never seen


def _gather(frame: pd.DataFrame) -> pd.DataFrame:
    """Counts for every token of a chunk's documents, and its histogram for the weights."""
    if frame["chunk"].iloc[0] == -1:
        total = sum(_unpack(p)[0] for p in frame["payload"])
        return pd.DataFrame({"kind": [1], "total": [int(total[0])], "kinds": [int(total[1])], "payload": [b""]})
    number, known, folds, offsets, text = _unpack(frame.loc[frame["kind"] == 0, "payload"].iloc[0])
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text.tobytes(), int(offsets[-1]) or 1), np.uint8)
    replies = frame[frame["kind"] == 2].sort_values("bucket")["payload"]
    train, held = (np.concatenate(c) for c in zip(*(_unpack(p) for p in replies)))
    one, two, first = _keys(data, offsets)
    keys = np.unique(np.concatenate([one, two]))
    place = np.searchsorted(keys, one)
    pair, end = np.searchsorted(keys, two), int(np.searchsorted(keys, _END & ~np.uint64(1)))
    context = np.empty_like(place)
    context[1:] = place[:-1]
    context[first[:-1]] = end
    word, both = train[place], train[pair]
    # Held-out tokens under the counts of the other training folds.
    out = np.repeat(folds, np.diff(first)) == HELD_FOLD
    w, vw, v = ((train - held)[k[out]].astype(np.float64) for k in (place, pair, context))
    seen = vw > 0
    ratio = np.log2((w[seen] + ADD) * v[seen] / vw[seen]) / BIN_STEP
    cell = np.zeros(len(w), np.int64)  # bin 0: the pair was never seen
    cell[seen] = np.clip(np.rint(ratio).astype(np.int64) + 32, 1, BINS - 1)
    histogram = np.bincount(_classes(v) * BINS + cell, minlength=CLASSES * BINS).astype(np.uint64)
    n_known = np.add.reduceat((word > 0).astype(np.int64), first[:-1])
    packed = _pack(number, known, folds, first, n_known, word.astype(np.uint32 if word.max() < 1 << 32 else np.uint64),
                   both.astype(np.uint32 if both.max() < 1 << 32 else np.uint64))
    return pd.DataFrame({"kind": [0, 2], "total": [0, 0], "kinds": [0, 0], "payload": [packed, _pack(histogram)]})


def learn_weights(histogram: np.ndarray, total: int, kinds: int, rounds: int = 100) -> np.ndarray:
    """Weight of the bigram estimate by class of context, by expectation maximisation."""
    ratio = 2.0 ** ((np.arange(BINS) - 32) * BIN_STEP) / (total + ADD * (kinds + 1))
    counts, weights = histogram.astype(np.float64), np.full(CLASSES, 0.5)
    size = counts.sum(axis=1)
    for _ in range(rounds):
        share = weights[:, None] / (weights[:, None] + (1 - weights[:, None]) * ratio)
        share[:, 0] = 0.0
        weights = np.where(size > 0, (counts * share).sum(axis=1) / np.maximum(size, 1), weights)
        weights = np.clip(weights, 1e-6, 1 - 1e-6)
    # A class without held-out tokens takes the weight of the nearest smaller one.
    for k in range(2, CLASSES):
        if size[k] == 0:
            weights[k] = weights[k - 1] if size[:k].any() else 0.5
    weights[0] = 0.0
    return weights


def bucket_count(source: DataFrame) -> int:
    """Buckets for a table with a ``text``: one for every ``BUCKET_BYTES``."""
    size = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, -(-size // BUCKET_BYTES))


def score(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    source = C.texts(docs).withColumn("fold", C.fold("doc_id", FOLDS))
    buckets = buckets or bucket_count(source)
    asked = source.mapInArrow(_ask(buckets), _ROW)
    # A partition for each bucket, so that no two meet by their hashes; as many for the chunks' own rows.
    own = buckets + F.pmod(F.xxhash64("dest"), F.lit(buckets))
    placed = asked.withColumn("slot", F.when(F.col("kind") == 1, F.col("dest")).otherwise(own).cast("int"))
    answered = placed.repartitionById(2 * buckets, F.col("slot")).groupBy("slot", "dest").applyInPandas(_answer, _ROW)
    counted = settle(answered.repartition(2 * buckets, "chunk").groupBy("chunk").applyInPandas(_gather, _COUNTED), "token-counts")
    sums = counted.where("kind = 1").agg(F.sum("total"), F.sum("kinds")).first()
    total, kinds = int(sums[0] or 0), int(sums[1] or 0)
    histogram = np.zeros(CLASSES * BINS, np.uint64)

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(CLASSES * BINS, np.uint64)
        for frame in frames:
            for p in frame["payload"]:
                held += _unpack(p)[0]
        at = np.flatnonzero(held)
        yield pd.DataFrame({"cell": at, "n": held[at].astype(np.int64)})

    for cell, n in (counted.where("kind = 2").select("payload").mapInPandas(add_up, "cell long, n long")
                    .groupBy("cell").agg(F.sum("n").alias("n")).collect()):  # at most CLASSES x BINS rows
        histogram[cell] = n
    weights = learn_weights(histogram.reshape(CLASSES, BINS), total, kinds)
    floor = total + ADD * (kinds + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for packed in frame["payload"]:
                number, known, folds, first, n_known, word, both = _unpack(packed)
                word, both = word.astype(np.float64), both.astype(np.float64)
                before = np.empty_like(word)  # the count of the word before; of the end, for the first
                before[1:] = word[:-1]
                before[first[:-1]] = word[first[1:] - 1]
                low = (word + ADD) / floor
                weight = weights[_classes(before)]
                full = np.log10(weight * both / np.maximum(before, 1) + (1 - weight) * low)
                yield pd.DataFrame({
                    "doc_id": pd.Series(number, dtype="Int64").mask(known == 0), "held_out": folds == 0, "n_tokens": np.diff(first),
                    "n_known": n_known, "train_tokens": total, "base_score": np.add.reduceat(np.log10(low), first[:-1]),
                    "score": np.add.reduceat(full, first[:-1])})

    return counted.where("kind = 0").mapInPandas(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
