"""Byte-level BPE encoding and decoding.

A text of more than ``chunk`` code points is cut into chunks that overlap by ``overlap``. Each is split into pre-tokens on
its own: where the text was read, or, if the text has more than ``spread`` code points, its chunks in many tasks. Neighbouring chunks are then stitched: where a boundary of one meets a boundary
of the next inside their overlap, the two runs agree from there on, so one piece ends and the next begins there. A
stitch also has a non-space before it and a white space after it: no match of the pattern runs over such a place.
Chunks without a stitch between them form one piece. Pieces are encoded separately and their ids put together in order.
Decoding looks up the bytes of every id and concatenates them.

Rules: null text is empty and has no tokens. Extra columns are ignored. Rows with the same id and the same text
give the same row each. A text of one chunk is one piece. The ids of a text are put together in one task. Where a
chunk is worked on changes no result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm import common as C
from barline.session import settle

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK_CHARS, OVERLAP_CHARS, SPREAD_CHARS = 1 << 12, 1 << 8, 1 << 16


@lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY):
    """The library's encoder over a vocabulary file; loaded once a worker."""
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    return regex.compile(public_tokenizers.PATTERN)


def encode(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of a text, as little-endian 32-bit integers."""
    return encoding(vocabulary).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@lru_cache(maxsize=2)
def _byte_table(vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes end to end; start and length by id."""
    enc = encoding(vocabulary)
    tokens = [enc.decode_single_token_bytes(k) for k in range(enc.n_vocab)]
    length = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length


def decode(ids: np.ndarray, vocabulary: str = VOCABULARY) -> bytes:
    """Raw bytes of all ids, concatenated."""
    pool, start, length = _byte_table(vocabulary)
    size = length[ids]
    first = np.cumsum(size) - size
    return pool[np.repeat(start[ids] - first, size) + np.arange(int(size.sum()))].tobytes()


def chunks(text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Stretches of ``chunk`` code points, each with the first ``overlap`` of the next one."""
    return [text[a:a + chunk + overlap] for a in range(0, len(text), chunk)]


def edges(text: str, start: int, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk that begins at ``start``: those in its own beginning, and stitchable ones beyond its end."""
    found = [m.start() for m in _pattern().finditer(text)]
    heads = [start + b for b in found if b <= overlap]
    return heads, [start + b for b in found if b >= chunk and not text[b - 1].isspace() and text[b] in " \t\r\n"]


def pieces(text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """A text's chunks stitched to pieces."""
    if len(text) <= chunk:
        return [text]
    ends = [edges(t, k * chunk, chunk, overlap) for k, t in enumerate(chunks(text, chunk, overlap))]
    shared = [min(set(left[1]).intersection(right[0]), default=None) for left, right in zip(ends, ends[1:])]
    starts = [0, *(s for s in shared if s is not None)]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def _stitched(edged: DataFrame, chunk: int) -> DataFrame:
    """Begin and end of what each chunk adds, its piece (number of the piece's first chunk) and the piece's chunks.

    A chunk ends at the first boundary it shares with the next. One row a chunk, without its text."""
    along = Window.partitionBy("row").orderBy("at")
    cut = edged.select("row", "at", F.array_min(F.array_intersect("tails", F.lead("heads").over(along))).alias("stitch"))
    cut = cut.withColumn("start", F.lag("stitch").over(along))
    cut = cut.withColumn("of", F.last(F.when((F.col("at") == 0) | F.col("start").isNotNull(), F.col("at")), ignorenulls=True).over(along))
    return cut.select("row", "at", "of", F.coalesce("start", F.col("at").cast("long") * chunk).alias("begin"),
                      F.coalesce("stitch", (F.col("at").cast("long") + 1) * chunk).alias("end"),
                      F.count("*").over(Window.partitionBy("row", "of")).alias("parts"))


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
               spread: int = SPREAD_CHARS) -> DataFrame:
    """``doc_id, text, ids, decoded``: ids as packed little-endian 32-bit integers, decoded as raw bytes."""
    source = C.texts(docs)
    long = F.length("text") > spread

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in range(0, len(frame), 256):
                piece = frame.iloc[part:part + 256]
                ids = [np.concatenate([encode(p, vocabulary) for p in pieces(t, chunk, overlap)]) for t in piece["text"]]
                yield piece.assign(ids=[i.tobytes() for i in ids], decoded=[decode(i, vocabulary) for i in ids])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, text, row in zip(frame["doc_id"], frame["text"], frame["row"]):
                parts = chunks(text, chunk, overlap)
                ids = pd.array([doc_id], "Int64").repeat(len(parts))
                yield pd.DataFrame({"doc_id": ids, "row": row, "at": range(len(parts)), "chunk": parts})

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [edges(t, k * chunk, chunk, overlap) for t, k in zip(frame["chunk"], frame["at"])]
            yield pd.DataFrame({"row": frame["row"], "at": frame["at"], "heads": [f[0] for f in found], "tails": [f[1] for f in found]})

    def encoder(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t[b - k * chunk:e - k * chunk] for t, k, b, e in zip(frame["chunk"], frame["at"], frame["begin"], frame["end"])]
            alone = frame["parts"] == 1
            yield frame[["doc_id", "row", "of", "at"]].assign(
                piece=[None if one else t for t, one in zip(texts, alone)],
                ids=[encode(t, vocabulary).tobytes() if one else None for t, one in zip(texts, alone)])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        text = "".join(frame.sort_values("at")["piece"])
        return frame.iloc[:1][["doc_id", "row", "of"]].assign(ids=[encode(text, vocabulary).tobytes()])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(frame.sort_values("of")["ids"])
        decoded = decode(np.frombuffer(ids, "<u4"), vocabulary)
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[:1], "text": [decoded.decode()], "ids": [ids], "decoded": [decoded]})

    # A row is named by where it was read; its chunks are dealt to many tasks.
    dealt = settle(source.where(long).withColumn("row", F.monotonically_increasing_id())
                   .mapInPandas(cut, "doc_id long, row long, at int, chunk string").repartition("row", "at"), "chunks")
    places = _stitched(dealt.mapInPandas(split, "row long, at int, heads array<long>, tails array<long>"), chunk)
    encoded = settle(dealt.join(places, ["row", "at"]).mapInPandas(
        encoder, "doc_id long, row long, of int, at int, piece string, ids binary"), "pieces")
    piece = "doc_id long, row long, of int, ids binary"
    several = encoded.where("ids IS NULL").groupBy("row", "of").applyInPandas(merged, piece)
    joined = (encoded.where("ids IS NOT NULL").select("doc_id", "row", "of", "ids").unionByName(several)
            .groupBy("row").applyInPandas(join, "doc_id long, text string, ids binary, decoded binary"))
    return source.where(~long).mapInPandas(whole, "doc_id long, text string, ids binary, decoded binary").unionByName(joined)


def digests(docs: DataFrame, **parameters) -> DataFrame:
    """One row a document: counts and digests of ids and decoded bytes."""
    return round_trip(docs, **parameters).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
