"""Centroid clustering with exact integers, filtered by n-simplex projection.

The starting centroids serve as pivots. Distances of a vector to the pivots are measured once; with the pivots as the
base of a simplex they give the vector's apex: its coordinates in the space of the pivots, and its altitude over it.
The Euclidean distance of two apexes on the same side is a lower bound of the distance of their vectors, that of
apexes on opposite sides an upper bound. Each round projects the centroids in the same way. A centroid whose lower
bound exceeds another's upper bound (with room for rounding) is not compared; the others are, in whole numbers.

Rules: kept are vectors with exactly ``DIMS`` components, none null or non-finite; a component becomes
floor(``SCALE`` * x). Components whose squared distances could pass a long are an error. Centroids start as the
vectors with the smallest hashes of their ids; rows with one id and different vectors follow each other by
their packed components, null ids come last. With fewer vectors than centroids each vector starts one. Repeated rows count as
often as they occur. Extra columns are ignored; an empty table gives no rows.

Tasks send a count and sums for each centroid, never a vector; the driver holds centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import settle

DIMS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
LARGEST = 1 << 27  # 64 squares of differences up to 2**28 stay below 2**63
_ROOM = 1e-4  # rounding of a bound, as a share of the squared lengths it is made of


def whole(batch: pa.RecordBatch, column: str, scale: int, dims: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose vector is finite throughout (and has ``dims`` components), with their vectors as whole numbers."""
    array = batch.column(batch.schema.get_field_index(column))
    lengths = np.diff(np.asarray(array.offsets)) if len(array) else np.zeros(0, np.int64)
    good = np.asarray(array.is_valid()) if len(array) else np.zeros(0, bool)
    flat = array.values.cast(pa.float64())
    finite = np.isfinite(np.asarray(flat.fill_null(np.nan)))
    starts = np.asarray(array.offsets)[:-1] if len(array) else np.zeros(0, np.int64)
    ends = starts + lengths
    bad = np.concatenate([[0], np.cumsum(~finite)])
    good &= bad[ends] == bad[starts]
    if dims is not None:
        good &= lengths == dims
    values = np.floor(np.asarray(flat.fill_null(0.0)) * float(scale))
    rows = np.flatnonzero(good)
    made = [values[starts[k]:ends[k]] for k in rows]
    if any(len(v) and np.abs(v).max() >= LARGEST for v in made):
        raise ValueError(f"a component of {column} is too large: results would not fit a long")
    return rows, made


class Simplex:
    """Projects vectors by their squared distances to pivots; pivots that depend on others are left out."""

    def __init__(self, pivots: np.ndarray):
        base = pivots.astype(np.float64)
        chosen, rows = [0], []
        shifted = base - base[0]
        longest = max(1.0, float((shifted ** 2).sum(axis=1).max()))
        for k in range(1, len(base)):
            rest = shifted[k].copy()
            for unit in rows:
                rest -= (rest @ unit) * unit
            if rest @ rest > 1e-3 * longest:
                rows.append(rest / np.sqrt(rest @ rest))
                chosen.append(k)
        self.pivots = pivots[chosen].astype(np.int64)
        edges = shifted[chosen[1:]]
        self.factor = np.linalg.inv(np.linalg.cholesky(edges @ edges.T)) if len(rows) else np.zeros((0, 0))
        self.edge2 = (edges ** 2).sum(axis=1)

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates over the base, the altitude last; from distances to the pivots alone."""
        far = np.stack([((vectors - p) ** 2).sum(axis=1) for p in self.pivots], axis=1).astype(np.float64)
        over = (far[:, :1] + self.edge2 - far[:, 1:]) / 2 @ self.factor.T
        height = np.sqrt(np.maximum(far[:, 0] - (over ** 2).sum(axis=1), 0))
        return np.concatenate([over, height[:, None]], axis=1)


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each vector, and how many comparisons were made."""
    flat = ((apexes[:, None, :-1] - tops[None, :, :-1]) ** 2).sum(axis=2)
    low = flat + (apexes[:, None, -1] - tops[None, :, -1]) ** 2
    high = flat + (apexes[:, None, -1] + tops[None, :, -1]) ** 2
    room = _ROOM * (1 + (apexes ** 2).sum(axis=1)[:, None] + (tops ** 2).sum(axis=1)[None, :])
    left = low - room <= (high + room).min(axis=1)[:, None]
    best, who = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), np.int32)
    for k, centroid in enumerate(centroids):
        at = np.flatnonzero(left[:, k])
        distance = ((vectors[at] - centroid) ** 2).sum(axis=1)
        closer = distance < best[at]
        best[at[closer]], who[at[closer]] = distance[closer], k
    return who, best, int(left.sum())


def _vectors(source: DataFrame, column: str) -> DataFrame:
    """``vec_id``, ``vector``: the kept vectors as packed whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = whole(batch, column, SCALE, DIMS)
            packed = pa.array([v.astype("<i4").tobytes() for v in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), packed], ["vec_id", "vector"])

    return source.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias(column)
                         ).mapInArrow(run, "vec_id long, vector binary")


def _unpack(batch: pa.RecordBatch, name: str, dtype: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _start(vectors: DataFrame, centroids: int) -> np.ndarray:
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(hashed.asc_nulls_last(), "vector").limit(centroids).collect()
    return np.array([np.frombuffer(r["vector"], "<i4") for r in first], np.int64).reshape(-1, DIMS)


def _sums(table: DataFrame, centroids: np.ndarray, tops: np.ndarray) -> list:
    """``cluster``, ``n`` and the sums of the components of each non-empty cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIMS), np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = _unpack(batch, "vector", "<i4").astype(np.int64)
                who, _, _ = nearest(vectors, _unpack(batch, "apex", "<f8"), centroids, tops)
                n += np.bincount(who, minlength=len(centroids))
                np.add.at(sums, who, vectors)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]),
                                          pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = table.select("vector", "apex").mapInArrow(run, "cluster int, n long, sums array<long>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[d]) for d in range(DIMS))).alias("sums")).collect()


def cluster(source: DataFrame, column: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS
            ) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``cluster``, ``distance`` of every kept vector, and the final centroids.

    Each round assigns every vector and moves each non-empty centroid to the floor of its mean; then all are
    assigned once more. Equally near centroids: the smaller number.
    """
    vectors = settle(_vectors(source, column), "vectors")
    now = _start(vectors, centroids)
    if len(now) == 0:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), now
    simplex = Simplex(now)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apexes = simplex.apexes(_unpack(batch, "vector", "<i4").astype(np.int64)).astype("<f8")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a in apexes], pa.binary())],
                                                 ["vec_id", "vector", "apex"])

    table = settle(vectors.mapInArrow(project, "vec_id long, vector binary, apex binary"), "apexes")
    for _ in range(rounds):
        moved = now.copy()
        for row in _sums(table, now, simplex.apexes(now)):
            moved[row["cluster"]] = [s // row["n"] for s in row["sums"]]
        now = moved
    tops = simplex.apexes(now)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                who, distance, _ = nearest(_unpack(batch, "vector", "<i4").astype(np.int64), _unpack(batch, "apex", "<f8"), now, tops)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return settle(table.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned"), now


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, last = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    inertia = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    # One row a centroid: what a cluster's rows have in common.
    named = [(k, inertia.get(k, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
             for k, c in enumerate(last)]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(k: int) -> str:
    """One assignment and one move of the centroids ``c{k}`` to ``c{k + 1}``."""
    return f""" a{k} AS (SELECT i, v, arg_min(k, (list_sum(list_transform(v, lambda x, j: (x - c[j]) * (x - c[j]))), k)) AS k
   FROM kept, c{k} GROUP BY i, v),
 m{k} AS (SELECT k, list(m ORDER BY d) AS c FROM (SELECT k, d, floor(sum(v[d]) / count(*)) AS m
   FROM a{k}, range(1, {DIMS + 1}) r(d) GROUP BY k, d) GROUP BY k),
 c{k + 1} AS (SELECT c{k}.k, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON c{k}.k = m{k}.k),"""


SQL = f"""WITH kept AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
   FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
 c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v AS c FROM kept
   ORDER BY sha256('1:' || vec_id), v LIMIT {CENTROIDS}),
{"".join(_round(k) for k in range(ROUNDS))}
 f AS (SELECT i, vec_id, min((list_sum(list_transform(v, lambda x, j: (x - c[j]) * (x - c[j]))), k)) AS best
   FROM kept, c{ROUNDS} GROUP BY i, vec_id),
 g AS (SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance FROM f)
 SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
   CAST(sum(distance) OVER () AS BIGINT) AS inertia,
   sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
 FROM g JOIN c{ROUNDS} ON cluster = k"""
