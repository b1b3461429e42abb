"""Clustering and hard negatives against brute force: nulls, repeats, ties, short vectors, clashing columns, empty tables."""

import collections
import hashlib
import math

import numpy as np
import pytest

from barline.llm import centroids, hard_negatives

SCHEMA = ("vec_id long, embedding array<float>, label int, cluster string, distance string, apex string, vector string, block string, "
          "chunk string, page string, place string, low string, rank string, n long")
EXTRA = ("x",) * 10 + (1,)


def _rows(n, seed=3, spread=0.2):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, 64)) * 0.3
    made = []
    for k in range(n):
        vector = middles[k % 12] + rng.normal(size=64) * spread * (k % 3)
        made.append((k, [float(np.float32(v)) for v in vector], int(k % 10 if k % 4 else 3), *EXTRA))
    return made


@pytest.fixture(scope="module")
def rows():
    out = _rows(700)
    out += [out[100], out[100], out[5], (None, out[9][1], 2, *EXTRA), (9000, None, 1, *EXTRA), (9100, out[3][1], None, *EXTRA),
            (9200, [0.5] * 63, 1, *EXTRA), (9300, [0.5] * 63 + [None], 1, *EXTRA), (9400, [0.5] * 63 + [math.nan], 1, *EXTRA),
            (9500, [0.5] * 63 + [math.inf], 1, *EXTRA), (9600, [], 1, *EXTRA), (9700, [-0.25] * 64, 7, *EXTRA), (300, [0.1] * 64, 4, *EXTRA)]
    return out + [(10_000 + k, out[200][1], 5, *EXTRA) for k in range(300)]  # one vector many times: ties


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def _finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _lloyd(rows):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if _finite(v) and len(v) == 64]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes())
    now = np.array([v for _, v in sorted(kept, key=key)[:16]], np.int64)
    x = np.array([v for _, v in kept], np.int64)
    for turn in range(4):
        far = ((x[:, None, :] - now[None]) ** 2).sum(axis=2)
        who = far.argmin(axis=1)
        if turn < 3:
            now = np.array([[int(s) // int((who == k).sum()) for s in x[who == k].sum(axis=0)] if (who == k).any() else now[k] for k in range(len(now))])
    return [(i, int(k), int(f[k])) for (i, _), k, f in zip(kept, who, far)], now


def test_clusters_match_brute_force(table, rows):
    want, last = _lloyd(rows)
    got, now = centroids.cluster(table)
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(want)
    assert (now == last).all()


def test_bounds_hold_and_filter(rows):
    x = np.array([[math.floor(64 * v) for v in r[1]] for r in rows[:700]], np.int64)
    simplex = centroids.Simplex(x[:16])
    apexes = simplex.apexes(x)
    spots, true = x[16:40], ((x[:, None] - x[None, 16:40]) ** 2).sum(axis=2)
    tops = simplex.apexes(spots)
    low = ((apexes[:, None] - tops[None]) ** 2).sum(axis=2)
    turned = tops * np.array([1.0] * (tops.shape[1] - 1) + [-1.0])
    high = ((apexes[:, None] - turned[None]) ** 2).sum(axis=2)
    assert (low <= true * (1 + 1e-9) + 1e-3).all() and (high >= true * (1 - 1e-9) - 1e-3).all()
    who, best, compared = centroids.nearest(x, apexes, spots, tops)
    assert (who == true.argmin(axis=1)).all() and (best == true.min(axis=1)).all()
    assert compared < 0.5 * true.size  # most comparisons are spared


@pytest.mark.parametrize("pivots", [[[0] * 64], [[3] * 64] * 16, [[k] * 64 for k in range(16)], [[1 << 26] * 64, [-(1 << 26)] * 64]])
def test_dependent_pivots_and_large_values(pivots):
    pivots = np.array(pivots, np.int64)
    x = np.random.default_rng(0).integers(-(1 << 26), 1 << 26, (50, 64))
    simplex = centroids.Simplex(pivots)
    who, best, _ = centroids.nearest(x, simplex.apexes(x), pivots, simplex.apexes(pivots))
    true = ((x[:, None] - pivots[None]) ** 2).sum(axis=2)
    assert (who == true.argmin(axis=1)).all() and (best == true.min(axis=1)).all()


def test_few_or_no_vectors(spark, rows):
    got, now = centroids.cluster(spark.createDataFrame(rows[:3], SCHEMA))
    assert len(now) == 3 and [r.distance for r in got.collect()] == [0, 0, 0]
    for none in ([], rows[704:705]):
        got, now = centroids.cluster(spark.createDataFrame(none, SCHEMA))
        assert got.columns == ["vec_id", "cluster", "distance"] and got.count() == 0 and len(now) == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64, 1, *EXTRA)], SCHEMA))


def _mined(rows):
    kept = [(i, label, np.array([math.floor(256 * x) for x in v] + [0] * (64 - len(v)), np.int64))
            for i, v, label, *_ in rows if i is not None and label is not None and _finite(v)]
    out = []
    for at, (anchor, own, vector) in enumerate(kept):
        if anchor % 100:
            continue
        scored = [(-int(v @ vector), i, label) for k, (i, label, v) in enumerate(kept) if k != at]
        for s, positive, _ in sorted(r for r in scored if r[2] == own)[:5]:
            fits = sorted(r for r in scored if r[2] != own and 30 * -s <= 100 * -r[0] <= 90 * -s)[:10]
            out += [(anchor, positive, rank + 1, i, -s, -n) for rank, (n, i, _) in enumerate(fits)]
    return collections.Counter(out)


@pytest.mark.parametrize("block, chunk, page", [(1024, 512, 256), (16, 3, 4)])
def test_hard_negatives_match_brute_force(table, rows, monkeypatch, block, chunk, page):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("PAGE", page)):
        monkeypatch.setattr(hard_negatives, name, value)
    want = _mined(rows)
    got = hard_negatives.mine(table)
    assert dict(got.dtypes)["rank"] == "int" and len(want) > 300
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_zone_maps_spare_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    table, dims = hard_negatives.blocks(spark.createDataFrame(_rows(1200, spread=0.01), SCHEMA).repartition(5))
    chunks = hard_negatives._chunks(table, dims, 100, 5)
    pages, n = hard_negatives._pages(table)
    tiles = hard_negatives._tiles(chunks, pages, n, dims, hard_negatives._wanted_positives).collect()
    assert sum(len(t.who) // 4 for t in tiles) < 0.2 * table.count() * 12


def test_no_rows_and_one_row(spark, rows):
    for few in ([], rows[:1], rows[704:705], [(9600, [], 1, *EXTRA)]):
        assert hard_negatives.mine(spark.createDataFrame(few, SCHEMA)).count() == 0


def test_hilbert_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        place = hard_negatives.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(side ** dims))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_of_boxes():
    rng = np.random.default_rng(1)
    anchors, rows = rng.integers(-50, 50, (6, 8)), rng.integers(-50, 50, (40, 8))
    low, high = hard_negatives.bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    assert (low <= (anchors @ rows.T).min(axis=1)[:, None]).all() and (high >= (anchors @ rows.T).max(axis=1)[:, None]).all()
    big = rng.integers(-(1 << 26), 1 << 26, (3, 64))
    assert hard_negatives.products(big, big).tolist() == [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in big] for p in big]
