"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may appear with up to e edits. It is split into e + 1 pieces: any text within the
budget holds one of them unchanged. All pieces are searched at once with an Aho-Corasick automaton; around a hit,
Myers' bit-parallel algorithm finds the least edit distance of the item to any substring.

Text is compared in lower case with each run of white space as one blank. The budget is ``rate`` of an item's
length, at least ``least``. Documents are read once for each block of at most ``BLOCK_PIECES`` pieces, so that the
automaton a task holds is bounded while the items are all searched in all documents.

Rules: null or empty texts match nothing; null or blank items, and items so short that the budget could erase them,
are ignored; items with the same text are all reported. Extra columns are ignored. A row of the result is a pair
(document row, item), so repeated documents repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import common as C
from barline.session import settle

RATE, LEAST = 0.05, 2
BLOCK_PIECES = 200_000


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def budget(size: int, rate: float = RATE, least: int = LEAST) -> int:
    return max(least, int(size * rate))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """Offset and text of ``edits`` + 1 pieces of nearly equal length."""
    n = edits + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def alphabet(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def least_distance(masks: dict[str, int], size: int, text: str, edits: int) -> int:
    """Least edit distance of the item to a substring of ``text``, by Myers' bit vectors; edits + 1 if above."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best = full, 0, size, edits + 1
    get = masks.get
    for k, c in enumerate(text):
        equal = get(c, 0)
        across = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score < best:
            best = score
            if best == 0:
                return 0
        up, down = up << 1 & full, down << 1 & full
        vertical = equal | minus
        plus, minus = down | full & ~(vertical | up), up & vertical
    return best


def search(text: str, automaton, items: list[tuple[int, int, dict[str, int]]]) -> Iterator[tuple[int, int]]:
    """(item number, distance) of every item within its budget in a normalised text."""
    places: dict[int, list[int]] = {}
    for end, owners in automaton.iter(text):
        for number, tail in owners:
            places.setdefault(number, []).append(end + 1 - tail)
    for number, starts in places.items():
        size, edits, masks = items[number]
        best, starts, k = edits + 1, sorted(starts), 0
        while k < len(starts) and best:
            low = high = starts[k]
            while k < len(starts) and starts[k] <= high + 2 * edits:
                high = starts[k]
                k += 1
            best = min(best, least_distance(masks, size, text[max(0, low - edits):high + size + edits], edits))
        if best <= edits:
            yield number, best


def _blocks(items: list[tuple[object, str]], rate: float, least: int) -> Iterator[list[tuple[object, str, int]]]:
    block, held = [], 0
    for item_id, text in items:
        edits = budget(len(text), rate, least)
        if len(text) <= 2 * edits + 1:
            continue
        block.append((item_id, text, edits))
        held += edits + 1
        if held >= BLOCK_PIECES:
            yield block
            block, held = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, *more: str, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """``doc_id``, the further columns, ``item_id``, ``distance`` of every document row and item within budget.

    The benchmark is a query set: it is streamed to the driver item by item and dealt into blocks of bounded size.
    """
    source = C.texts(docs, *more)
    held = [f for f in source.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held) + ", item_id long, distance long"
    out = None
    for block in _blocks(_items(benchmark), rate, least):
        part = source.mapInPandas(_searcher(block, [f.name for f in held]), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else source.sparkSession.createDataFrame([], schema)


def _items(benchmark: DataFrame) -> Iterator[tuple[object, str]]:
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return ((r[0], normalise(r[1])) for r in rows.toLocalIterator())


def _built(block: list[tuple[object, str, int]]) -> tuple[object, list[tuple[int, int, dict[str, int]]]]:
    """The automaton over a block's pieces, and length, budget and letters of its items."""
    import ahocorasick

    automaton, owners, items = ahocorasick.Automaton(), {}, []
    for number, (_, item, edits) in enumerate(block):
        items.append((len(item), edits, alphabet(item)))
        for at, piece in pieces(item, edits):
            owners.setdefault(piece, []).append((number, at + len(piece)))
    for piece, where in owners.items():
        automaton.add_word(piece, where)
    automaton.make_automaton()
    return automaton, items


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The rows of ``docs``, unchanged, that no item matches; nothing is shuffled.

    What a block of items leaves is written before the next one, so that a task holds one automaton at a time."""

    def keeper(block: list[tuple[object, str, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, items = _built(block)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([t is None or next(search(normalise(t), automaton, items), None) is None for t in texts], pa.bool_()))

        return run

    for number, block in enumerate(_blocks(_items(benchmark), rate, least)):
        docs = (settle(docs, "cleaned") if number else docs).mapInArrow(keeper(block), docs.schema)
    return docs


def _searcher(block: list[tuple[object, str, int]], held: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, items = _built(block)
        for frame in frames:
            found = [(k, number, distance) for k, text in enumerate(frame["text"])
                     for number, distance in search(normalise(text), automaton, items)]
            out = frame.iloc[[f[0] for f in found]][held].reset_index(drop=True)
            yield out.assign(item_id=pd.array([block[f[1]][0] for f in found], "Int64"), distance=[f[2] for f in found])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """One row a matching document: ``doc_id``, ``items`` (sorted list of item ids), ``distance`` (the least)."""
    return (matches(docs, benchmark, **parameters).groupBy("doc_id")
            .agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.min("distance").alias("distance")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
