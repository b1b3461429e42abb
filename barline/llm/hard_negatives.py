"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Rows are ordered by label and by their place on a Hilbert curve through the dimensions of largest variance, and are
written as blocks of at most ``BLOCK`` rows: Parquet rows that hold packed vectors next to a zone map, the smallest
and largest value of each dimension and label. The inner product of an anchor with any row of a block lies between
two sums of products with the block's bounds. So the zone maps alone choose the blocks to be read:

* positives: blocks with the anchor's label whose upper bound reaches the anchor's fifth best score in its own block,
  whose rows are its neighbours on the curve;
* negatives: blocks with other labels whose bounds meet one of the anchor's score windows.

Anchors are packed into chunks, zone maps into pages; a task compares a chunk with a page, or with a block that the
page has chosen for some of its anchors. The best rows of each task are cut down before they are shuffled.

Rules: rows with a null id, label or vector, or a null or non-finite component take no part. Missing components of
shorter vectors count as 0. Components that could make a score pass a long are an error. Repeated rows are rows of
their own: an anchor's copy is one of its other rows, and a repeated anchor is mined twice. Extra columns are
ignored. Few rows give few positives and negatives; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm.centroids import whole
from barline.session import settle

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
BLOCK, CHUNK, PAGE = 1024, 512, 256  # rows in a block, anchors in a chunk, zone maps in a page
TASK_ROWS = 1 << 20
CURVE_DIMS, CURVE_BITS = 16, 4


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (row of coordinates below 2**bits) on the Hilbert curve, as an unsigned number.

    Coordinates are turned and mirrored level by level from the highest bit, then Gray-decoded.
    """
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        rest = bit - one
        for axis in range(dims):
            far = (x[axis] & bit) != 0
            swap = np.where(far, np.uint64(0), (x[0] ^ x[axis]) & rest)
            x[0] ^= np.where(far, rest, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        turn ^= np.where((x[-1] & bit) != 0, bit - one, np.uint64(0))
    x ^= turn
    place = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            place = (place << one) | ((x[axis] >> np.uint64(level)) & one)
    return place


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that any point of each box can have with each anchor."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def _clean(source: DataFrame, column: str) -> DataFrame:
    """``vec_id``, ``label``, ``vector`` (packed whole numbers) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = whole(batch, column, SCALE)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at),
                                              pa.array([v.astype("<i4").tobytes() for v in made], pa.binary())], ["vec_id", "label", "vector"])

    named = source.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col(column).cast("array<double>").alias(column)).where("vec_id IS NOT NULL AND label IS NOT NULL")
    return named.mapInArrow(run, "vec_id long, label long, vector binary")


def _matrix(packed: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(packed), dims), np.int32)
    for k, row in enumerate(packed):
        values = np.frombuffer(row, "<i4")
        out[k, :len(values)] = values
    return out


def _spread(rows: DataFrame) -> list:
    """``n``, sum, sum of squares, least and greatest value of each dimension, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[float]] = {}
        for batch in batches:
            vectors = [np.frombuffer(v, "<i4") for v in batch.column(0).to_pylist()]
            for dims in {len(v) for v in vectors}:
                x = np.array([v for v in vectors if len(v) == dims], np.float64)
                for d in range(dims):
                    old = parts.get(d, [0, 0.0, 0.0, math.inf, -math.inf])
                    parts[d] = [old[0] + len(x), old[1] + x[:, d].sum(), old[2] + (x[:, d] ** 2).sum(),
                                min(old[3], x[:, d].min()), max(old[4], x[:, d].max())]
        columns = list(zip(*([d, *p] for d, p in parts.items()))) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64())]
                                         + [pa.array(c, pa.float64()) for c in columns[2:]], ["d", "n", "s", "q", "low", "high"])

    parts = rows.select("vector").mapInArrow(run, "d int, n long, s double, q double, low double, high double")
    return parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
                                  F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()


def _placed(rows: DataFrame, spread: list) -> DataFrame:
    """``rows`` with ``place``, their place on the curve as a long."""
    varied = sorted(spread, key=lambda r: (-(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2), r["d"]))[:CURVE_DIMS]
    axes, low = [r["d"] for r in varied], np.array([r["low"] for r in varied])
    width = np.array([max(1.0, r["high"] - r["low"] + 1) for r in varied])
    dims = max(1, len(spread))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2).to_pylist(), dims)[:, axes]
            cells = np.clip((x - low) / width * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1)
            place = (hilbert(cells, CURVE_BITS) ^ np.uint64(1 << 63)).astype(np.int64) if axes else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], ["vec_id", "label", "vector", "place"])

    return rows.mapInArrow(run, "vec_id long, label long, vector binary, place long")


def blocks(source: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """The written blocks, ``block``, ``n``, ``label_low``, ``label_high``, ``low``, ``high`` (the zone map), ``ids``,
    ``labels``, ``vectors`` (packed), and the number of dimensions. A block's rows are in order of their ids."""
    rows = settle(_clean(source, column), "vectors")
    spread = _spread(rows)
    dims, n = max(1, len(spread)), rows.count()
    shuffled = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(math.ceil(n / BLOCK), max(shuffled, math.ceil(n / TASK_ROWS))))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, held = TaskContext.get().partitionId(), 0, None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame])
            while len(held) >= BLOCK:
                yield write(held[:BLOCK], part, made)
                held, made = held[BLOCK:], made + 1
        if held is not None and len(held):
            yield write(held, part, made)

    def write(frame: pd.DataFrame, part: int, k: int) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        x, labels = _matrix(list(frame["vector"]), dims), frame["label"].to_numpy(np.int64)
        return pd.DataFrame({"block": [(part << 32) + k], "n": [len(x)], "label_low": [labels.min()], "label_high": [labels.max()],
                             "low": [x.min(axis=0).tobytes()], "high": [x.max(axis=0).tobytes()],
                             "ids": [frame["vec_id"].to_numpy("<i8").tobytes()], "labels": [labels.tobytes()], "vectors": [x.tobytes()]})

    order = ["label", "place", "vec_id"]
    dealt = _placed(rows, spread).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = "block long, n long, label_low long, label_high long, low binary, high binary, ids binary, labels binary, vectors binary"
    return settle(dealt.mapInPandas(pack, schema), "blocks"), dims


def _block(row, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(row.ids, "<i8"), np.frombuffer(row.labels, "<i8"), np.frombuffer(row.vectors, "<i4").reshape(-1, dims))


def _chunks(table: DataFrame, dims: int, every: int, positives: int) -> DataFrame:
    """Anchors, ``CHUNK`` at a time in the order of the curve: ``chunk``, and packed in it ``anchors`` (ids), ``labels``,
    ``homes`` (block), ``slots`` (place in the block), ``least`` (a score their positives reach), ``vectors``."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                ids, labels, x = _block(row, dims)
                at = np.flatnonzero(ids % every == 0)
                scores = products(x[at], x)
                least = []
                for k, slot in enumerate(at):
                    own = scores[k][(labels == labels[slot]) & (np.arange(len(ids)) != slot)]
                    least.append(np.sort(own)[-positives] if len(own) >= positives else np.iinfo(np.int64).min)
                yield pd.DataFrame({"home": row.block, "slot": at, "anchor": ids[at], "label": labels[at], "least": np.array(least, np.int64),
                                    "vector": [v.tobytes() for v in x[at]]})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, held = TaskContext.get().partitionId(), 0, None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame])
            while len(held) >= CHUNK:
                yield write(held[:CHUNK], part, made)
                held, made = held[CHUNK:], made + 1
        if held is not None and len(held):
            yield write(held, part, made)

    def write(frame: pd.DataFrame, part: int, k: int) -> pd.DataFrame:
        packed = lambda c: [frame[c].to_numpy("<i8").tobytes()]
        return pd.DataFrame({"chunk": [(part << 32) + k], "anchors": packed("anchor"), "labels": packed("label"), "homes": packed("home"),
                             "slots": packed("slot"), "least": packed("least"), "vectors": [b"".join(frame["vector"])]})

    found = settle(table.select("block", "ids", "labels", "vectors").mapInPandas(
        find, "home long, slot long, anchor long, label long, least long, vector binary"), "anchors")
    parts = max(1, math.ceil(found.count() / CHUNK))
    dealt = found.repartitionByRange(parts, "home", "slot").sortWithinPartitions("home", "slot")
    return settle(dealt.mapInPandas(pack, "chunk long, anchors binary, labels binary, homes binary, slots binary, least binary, vectors binary"), "chunks")


def _pages(table: DataFrame) -> tuple[DataFrame, int]:
    """The zone maps, at most ``PAGE`` of them in a row, numbered from 0; and how many rows there are."""
    zones = table.select("block", "label_low", "label_high", "low", "high")
    parts = max(1, math.ceil(zones.count() / PAGE))
    # A page holds what hashes to it; pages of more than PAGE maps cost memory in proportion, no result.
    return settle(zones.withColumn("page", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).groupBy("page").agg(
        F.collect_list(F.struct("block", "label_low", "label_high", "low", "high")).alias("zones")), "pages"), parts


def _tiles(chunks: DataFrame, pages: DataFrame, n_pages: int, dims: int, choose) -> DataFrame:
    """``chunk``, ``block``, ``who``: for which anchors of a chunk a block has to be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                zones = row.zones
                box = [np.frombuffer(b"".join(z[c] for z in zones), "<i4").reshape(len(zones), dims) for c in ("low", "high")]
                anchors = np.frombuffer(row.vectors, "<i4").reshape(-1, dims)
                need = choose(row, np.array([z["label_low"] for z in zones]), np.array([z["label_high"] for z in zones]), *bounds(anchors, *box))
                some = np.flatnonzero(need.any(axis=0))
                yield pd.DataFrame({"chunk": row.chunk, "block": [zones[k]["block"] for k in some],
                                    "who": [np.flatnonzero(need[:, k]).astype("<i4").tobytes() for k in some]})

    met = chunks.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1)))).join(pages, "page")
    return settle(met.mapInPandas(run, "chunk long, block long, who binary"), "tiles")


def _wanted_positives(row, label_low, label_high, low, high) -> np.ndarray:
    labels, least = np.frombuffer(row.labels, "<i8")[:, None], np.frombuffer(row.least, "<i8")[:, None]
    return (label_low <= labels) & (labels <= label_high) & (high >= least)


def windows(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score allowed by each positive score; none if the least is greater."""
    hundreds, rest = np.divmod(scores, 100)
    return LOW * hundreds - (-LOW * rest) // 100, HIGH * hundreds + HIGH * rest // 100


def _wanted_negatives(row, label_low, label_high, low, high) -> np.ndarray:
    labels = np.frombuffer(row.labels, "<i8")[:, None]
    need = np.zeros(low.shape, bool)
    for at, floor, ceiling in zip(*_windows_of(row)):
        need[at] |= (low[at] <= ceiling) & (high[at] >= floor) & (floor <= ceiling)
    return need & ~((label_low == labels) & (label_high == labels))


def _windows_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor's place in the chunk, least and greatest score of each window of a chunk."""
    at = np.frombuffer(row.at, "<i8")
    return (at, *windows(np.frombuffer(row.positive_scores, "<i8")))


def _scored(tiles: DataFrame, chunks: DataFrame, table: DataFrame, dims: int, pick, most: int, schema: str) -> DataFrame:
    """What ``pick`` takes from the scores of each tile's anchors in its block: a group (the first two columns), an id
    and a score. Of the tiles that reach a task together, each group keeps its ``most`` best rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for row in frame.itertuples():
                who = np.frombuffer(row.who, "<i4")
                ids, labels, x = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.row_labels, "<i8"), np.frombuffer(row.rows, "<i4").reshape(-1, dims)
                scores = products(np.frombuffer(row.vectors, "<i4").reshape(-1, dims)[who], x)
                found.append(pick(row, who, ids, labels, scores))
            if found:
                found = pd.concat(found)
                group, (named, score) = list(found.columns[:2]), found.columns[2:]
                yield found.sort_values([*group, score, named], ascending=[True, True, False, True], kind="stable").groupby(group, sort=False).head(most)

    side = table.select("block", "ids", F.col("labels").alias("row_labels"), F.col("vectors").alias("rows"))
    return tiles.join(chunks, "chunk").join(side, "block").mapInPandas(run, schema)


def _pick_positives(positives: int):
    def pick(row, who, ids, labels, scores) -> pd.DataFrame:
        own, homes, slots = (np.frombuffer(c, "<i8")[who] for c in (row.labels, row.homes, row.slots))
        out = []
        for k in range(len(who)):
            fits = labels == own[k]
            if homes[k] == row.block:
                fits[slots[k]] = False
            at = np.flatnonzero(fits)
            at = at[np.argsort(-scores[k][at], kind="stable")[:positives]]  # rows of a block are in order of ids
            out.append(np.stack([np.full(len(at), who[k]), ids[at], scores[k][at]]))
        found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pd.DataFrame({"chunk": row.chunk, "at": found[0], "positive_id": found[1], "positive_score": found[2]})

    return pick


def _pick_negatives(negatives: int):
    def pick(row, who, ids, labels, scores) -> pd.DataFrame:
        own = np.frombuffer(row.labels, "<i8")
        anchor, floors, ceilings = _windows_of(row)
        place = np.full(len(own), -1)
        place[who] = np.arange(len(who))
        out, order = [], {}
        for window, (a, floor, ceiling) in enumerate(zip(anchor, floors, ceilings)):
            k = place[a]
            if k < 0 or floor > ceiling:
                continue
            if k not in order:
                at = np.flatnonzero(labels != own[a])
                order[k] = at[np.argsort(-scores[k][at], kind="stable")]
            fall = -scores[k][order[k]]
            first, last = np.searchsorted(fall, -ceiling, "left"), np.searchsorted(fall, -floor, "right")
            at = order[k][first:min(last, first + negatives)]
            out.append(np.stack([np.full(len(at), window), ids[at], scores[k][at]]))
        found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pd.DataFrame({"chunk": row.chunk, "window": found[0], "negative_id": found[1], "negative_score": found[2]})

    return pick


def mine(source: DataFrame, column: str = "embedding", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``: for each anchor
    (id divisible by ``every``) and each of its positives, the best negatives in the positive's window.
    Higher scores come first, ties by smaller id."""
    table, dims = blocks(source, column)
    chunks = _chunks(table, dims, every, positives)
    pages, n_pages = _pages(table)

    tiles = _tiles(chunks, pages, n_pages, dims, _wanted_positives)
    scored = _scored(tiles, chunks, table, dims, _pick_positives(positives), positives, "chunk long, at long, positive_id long, positive_score long")
    best = Window.partitionBy("chunk", "at").orderBy(F.desc("positive_score"), "positive_id")
    found = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    # At most CHUNK * positives windows a chunk, packed in one order.
    packed = found.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "place", "positive_id", "positive_score"))).alias("p"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                take = lambda c: [np.array([p[c] for p in row.p], "<i8").tobytes()]
                yield pd.DataFrame({"chunk": [row.chunk], "at": take("at"), "positives": take("positive_id"), "positive_scores": take("positive_score")})

    aims = chunks.join(packed.mapInPandas(pack, "chunk long, at binary, positives binary, positive_scores binary"), "chunk")
    aims = settle(aims, "windows")

    tiles = _tiles(aims, pages, n_pages, dims, _wanted_negatives)
    scored = _scored(tiles, aims, table, dims, _pick_negatives(negatives), negatives, "chunk long, window long, negative_id long, negative_score long")
    best = Window.partitionBy("chunk", "window").orderBy(F.desc("negative_score"), "negative_id")
    kept = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)

    def name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                at, ids, scores = (np.frombuffer(c, "<i8") for c in (row.at, row.positives, row.positive_scores))
                yield pd.DataFrame({"chunk": row.chunk, "window": np.arange(len(at)), "anchor_id": np.frombuffer(row.anchors, "<i8")[at],
                                    "positive_id": ids, "positive_score": scores})

    named = aims.mapInPandas(name, "chunk long, window long, anchor_id long, positive_id long, positive_score long")
    return kept.join(named, ["chunk", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id carries the next label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"))


SQL = f"""WITH r AS (SELECT row_number() OVER () AS i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
   list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
     AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
 s AS (SELECT a.i, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
   CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a, r b WHERE a.vec_id % {EVERY} = 0 AND a.i <> b.i),
 p AS (SELECT i, anchor_id, other_id AS positive_id, score AS positive_score,
   row_number() OVER (PARTITION BY i ORDER BY score DESC, other_id) AS place FROM s WHERE same),
 n AS (SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
   row_number() OVER (PARTITION BY p.i, place ORDER BY score DESC, other_id) AS rank
   FROM p JOIN s ON p.i = s.i AND NOT same WHERE place <= {POSITIVES}
     AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
 SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
 FROM n WHERE rank <= {NEGATIVES}"""
