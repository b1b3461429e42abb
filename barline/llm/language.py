"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes in both directions (one gated recurrent layer each way), gives every
position a probability for each language, and a document gets the mean over its positions. It is trained in numpy
by backpropagation through time on windows drawn from at most ``TRAIN_DOCS`` labelled documents, chosen by a hash
of id and text. Each language has an equal share of them, as far as it has documents, so that a rare one is learned
as well (of more than ``TRAIN_DOCS`` languages the most frequent). Whole texts are labelled, window by window.

Rules: null text, and text without any letter, is ``und`` with score 0. Languages are those seen in training, in
alphabetical order; ties go to the first. Without any labelled document every text is ``und`` with score 0.
Extra columns are ignored; repeated rows are labelled each for itself. Only the text decides a prediction.
``keep_known`` drops what is ``und`` and nothing else, however unlikely.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import common as C

WINDOW, HIDDEN = 64, 8
TRAIN_DOCS, WINDOWS_A_DOC = 2000, 8
STEPS, BATCH, RATE, SEED = 250, 256, 0.02, 7
HELD_OUT_PARTS = 5
LETTER = r"\p{L}"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def new_weights(languages: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Input tables (one row a byte; gates reset, update, candidate side by side), recurrent and output weights."""
    weights = {}
    for side in ("f", "b"):
        weights[f"x{side}"] = rng.normal(0, 0.3, (257, 3 * HIDDEN))
        weights[f"u{side}"] = rng.normal(0, 0.3, (HIDDEN, 2 * HIDDEN))
        weights[f"v{side}"] = rng.normal(0, 0.3, (HIDDEN, HIDDEN))
        weights[f"o{side}"] = rng.normal(0, 0.3, (HIDDEN, languages))
    weights["bias"] = np.zeros(languages)
    return {k: v.astype(np.float32) for k, v in weights.items()}


def _forward(weights: dict, side: str, codes: np.ndarray, keep: bool = False):
    """States after every step of one direction: (steps, rows, hidden). Code 256 is padding."""
    h = np.zeros((codes.shape[0], HIDDEN), np.float32)
    states, trace = np.empty((codes.shape[1], codes.shape[0], HIDDEN), np.float32), []
    x, u, v = weights[f"x{side}"], weights[f"u{side}"], weights[f"v{side}"]
    steps = range(codes.shape[1]) if side == "f" else range(codes.shape[1] - 1, -1, -1)
    for t in steps:
        given = x[codes[:, t]]
        gates = _sigmoid(given[:, :2 * HIDDEN] + h @ u)
        reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(given[:, 2 * HIDDEN:] + (reset * h) @ v)
        if keep:
            trace.append((t, h, reset, update, new))
        h = new + update * (h - new)
        states[t] = h
    return states, trace


def _outputs(weights: dict, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Probabilities of every position: (steps, rows, languages)."""
    logits = ahead @ weights["of"] + back @ weights["ob"] + weights["bias"]
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    return logits / logits.sum(axis=-1, keepdims=True)


def gradients(weights: dict, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over real positions, and its gradient by backpropagation through time."""
    ahead, trace_f = _forward(weights, "f", codes, True)
    back, trace_b = _forward(weights, "b", codes, True)
    p = _outputs(weights, ahead, back)
    real = (codes.T != 256)[:, :, None]
    count = max(1, int(real.sum()))
    rows = np.arange(len(labels))
    loss = float(-(np.log(p[:, rows, labels] + 1e-9) * real[:, :, 0]).sum() / count)
    d = p.copy()
    d[:, rows, labels] -= 1
    d *= real / np.float32(count)
    grads = {"bias": d.sum((0, 1)), "of": np.einsum("tbh,tbl->hl", ahead, d), "ob": np.einsum("tbh,tbl->hl", back, d)}
    for side, trace in (("f", trace_f), ("b", trace_b)):
        outer = d @ weights[f"o{side}"].T
        u, v = weights[f"u{side}"], weights[f"v{side}"]
        gx, gu, gv = np.zeros_like(weights[f"x{side}"]), np.zeros_like(u), np.zeros_like(v)
        flow = np.zeros((codes.shape[0], HIDDEN), np.float32)
        for t, h, reset, update, new in reversed(trace):
            dh = flow + outer[t]
            d_new = dh * (1 - update) * (1 - new * new)
            d_update = dh * (h - new) * update * (1 - update)
            d_mixed = d_new @ v.T
            d_reset = d_mixed * h * reset * (1 - reset)
            d_gates = np.concatenate([d_reset, d_update], axis=1)
            gv += (reset * h).T @ d_new
            gu += h.T @ d_gates
            np.add.at(gx, codes[:, t], np.concatenate([d_gates, d_new], axis=1))
            flow = dh * update + d_mixed * reset + d_gates @ u.T
        grads |= {f"x{side}": gx, f"u{side}": gu, f"v{side}": gv}
    return loss, grads


def train(windows: np.ndarray, labels: np.ndarray, languages: int, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights after ``steps`` updates (Adam), each on a batch with as many windows of every language."""
    rng = np.random.default_rng(SEED)
    weights = new_weights(languages, rng)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    members = [np.flatnonzero(labels == k) for k in range(languages)]
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(m, BATCH // languages + 1) for m in members])
        _, grads = gradients(weights, windows[chosen], labels[chosen])
        rate = RATE * min(1.0, 3.0 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            weights[k] = (weights[k] - rate * (first[k] / (1 - 0.9**step))
                          / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return weights


def window_codes(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a block of texts, padded with 256, and the row of each."""
    size = np.diff(offsets)
    pieces = -(-size // window)
    row = np.repeat(np.arange(len(size)), pieces)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
    place = (offsets[:-1][row] + at)[:, None] + np.arange(window)
    inside = place < offsets[1:][row][:, None]
    codes = np.full(place.shape, 256, np.int16)
    codes[inside] = data[place[inside]]
    return codes, row


def label_positions(weights: dict, codes: np.ndarray) -> np.ndarray:
    """Probabilities of the languages at every position of every window: (window positions, windows, languages)."""
    return _outputs(weights, _forward(weights, "f", codes)[0], _forward(weights, "b", codes)[0])


def pooled(weights: dict, data: np.ndarray, offsets: np.ndarray, languages: int, at_once: int = 2048) -> np.ndarray:
    """Mean probability over the positions of each text: (rows, languages)."""
    codes, row = window_codes(data, offsets)
    total = np.zeros((len(offsets) - 1, languages))
    for a in range(0, len(codes), at_once):
        part = codes[a:a + at_once]
        sums = (label_positions(weights, part) * (part.T != 256)[:, :, None]).sum(axis=0)
        np.add.at(total, row[a:a + at_once], sums)
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def drawn(text: str) -> bytes:
    """``WINDOWS_A_DOC`` windows from anywhere in a text, end to end as 16-bit codes; the text alone decides which."""
    raw = np.frombuffer(text.encode(), np.uint8)
    rng = np.random.default_rng([SEED, zlib.crc32(raw)])
    at = rng.integers(0, max(1, len(raw) - WINDOW + 1), WINDOWS_A_DOC)
    place = at[:, None] + np.arange(WINDOW)
    return np.where(place < len(raw), raw[np.minimum(place, len(raw) - 1)].astype("<i2"), 256).astype("<i2").tobytes()


def _draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame[["rank", "lang"]].assign(windows=[drawn(t) for t in frame["text"]])


def _sample(docs: DataFrame, train_docs: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and labels (one a window) of at most ``train_docs`` labelled documents outside the held-out fold.

    Tasks draw the windows, so the driver takes a kilobyte a document, however long the texts are.
    """
    labelled = C.texts(docs, "lang").where(
        F.col("lang").isNotNull() & (C.fold("doc_id", HELD_OUT_PARTS) != 0) & F.col("text").rlike(LETTER))
    # Shares are set from counts, so that about the bound is read; the limit, by the same hash, holds the bound itself.
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(train_docs).collect()
    if not counts:
        return np.zeros((0, WINDOW), np.int16), np.zeros(0, np.int64), []
    known = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], r["count"])))
    # A document's place among those of its language: the hash, stretched to their number.
    span = 1 << 40
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(span)) / F.lit(float(span)) * F.element_at(known, F.col("lang"))
    ranked = labelled.withColumn("rank", place).where(F.col("rank") < 2.0 * train_docs / len(counts) + 10)
    sample = (ranked.select("rank", "lang", "text").mapInPandas(_draw, "rank double, lang string, windows binary")
              .orderBy("rank", "lang", "windows").limit(train_docs).toPandas())
    names = sorted(set(sample["lang"]))
    windows = np.frombuffer(b"".join(sample["windows"]), "<i2").reshape(-1, WINDOW)
    return windows, np.repeat([names.index(x) for x in sample["lang"]], WINDOWS_A_DOC), names


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[dict[str, np.ndarray], list[str]]:
    """Weights and language names."""
    windows, labels, names = _sample(docs, train_docs)
    return (train(windows, labels, len(names)), names) if names else ({}, [])


def keep_known(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` that are not ``und``, which is every text with a letter: the network learns from a sample, so no
    probability of its rejects a text. A null ``lang`` becomes the language predicted (it stays null without any label); all
    else is unchanged."""
    weights, names = fit(docs, train_docs)
    at = docs.columns.index("lang")

    def run(batches):
        for batch in batches:
            told = []
            if names:
                for _, _, data, offsets in C.text_blocks(batch):
                    told += [names[k] for k in pooled(weights, data, offsets, len(names)).argmax(axis=1)]
                kind = batch.schema.field(at).type
                filled = [k if given is None else given for given, k in zip(batch.column(at).to_pylist(), told)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(filled, kind))
            yield batch

    return docs.where(F.col("text").rlike(LETTER)).mapInArrow(run, docs.schema)


def predict(docs: DataFrame, weights: dict[str, np.ndarray], names: list[str], *more: str) -> DataFrame:
    """``doc_id``, the further columns asked for, ``lang_pred`` and ``score`` of every row."""
    source = C.texts(docs, *more).select(F.col("text").rlike(LETTER), "*")  # the first column, whatever the others are called
    held = source.schema.fields[1:2] + source.schema.fields[3:]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held) + ", lang_pred string, score double"

    def run(batches):
        for batch in batches:
            letters, keep = np.asarray(batch.column(0)), [batch.column(k) for k in (1, *range(3, batch.num_columns))]
            for first, end, data, offsets in C.text_blocks(batch):
                known = letters[first:end] & bool(names)
                pooling = pooled(weights, data, offsets, len(names)) if known.any() else np.zeros((end - first, 1))
                best, score = pooling.argmax(axis=1), np.minimum(pooling.max(axis=1), 1.0)
                label = [names[k] if ok else "und" for k, ok in zip(best, known)]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(first, end - first) for c in keep] + [pa.array(label, pa.string()), pa.array(np.where(known, score, 0.0))],
                    [f.name for f in held] + ["lang_pred", "score"])

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights, names = fit(docs)
    return predict(docs, weights, names).select(
        "doc_id", (C.fold("doc_id", HELD_OUT_PARTS) == 0).alias("held_out"), "lang_pred", "score")
