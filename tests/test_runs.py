"""Runs that no other run beats on every metric, against comparing all pairs."""

import random

import pytest

from barline.operators import runs


def _kept(rows):
    whole = [r for r in rows if all(v is not None and v == v for v in r[1:])]
    return sorted(r[0] for r in whole if not any(all(a < b for a, b in zip(o[1:], r[1:])) for o in whole))


@pytest.mark.parametrize("dims", [1, 2, 4, 6])
@pytest.mark.parametrize("block, seeds", [(8192, 64), (16, 0), (16, 3)])
def test_undominated_matches_all_pairs(spark, dims, block, seeds):
    rng = random.Random(dims)
    value = lambda: rng.choice((round(rng.random(), 2), rng.random(), float("inf") if rng.random() < 0.02 else 0.5))
    rows = [(f"r{k}", *(value() for _ in range(dims))) for k in range(400)]
    rows += [("null", *[None] * dims), ("nan", *[float("nan")] * dims), ("copy", *rows[0][1:]), ("half", *rows[1][1:dims], None)]
    names = [f"h{k}" for k in range(dims)]
    frame = spark.createDataFrame(rows, "run string, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    got = runs.undominated(frame, names, block=block, seeds=seeds)
    assert sorted(r.run for r in got.collect()) == _kept(rows)


def test_points_that_all_stay_are_checked_by_blocks(spark):
    """A front of points none of which beats another, and points just behind it: larger than any block."""
    rows = [(f"f{k}", float(k), float(1000 - k)) for k in range(1000)] + [(f"b{k}", k + 0.5, 1000.5 - k) for k in range(1000)]
    got = runs.undominated(spark.createDataFrame(rows, "run string, a double, b double").repartition(6), ["a", "b"], block=50, seeds=4)
    assert sorted(r.run for r in got.collect()) == sorted(f"f{k}" for k in range(1000))


def test_every_reported_horizon_counts(spark):
    rows = [("a", 1, 1.0), ("a", 7, 2.0), ("a", 30, 9.0), ("b", 1, 2.0), ("b", 7, 3.0), ("b", 30, 1.0), ("c", 1, 0.1)]
    wide, names = runs.wide_horizons(spark.createDataFrame(rows, "run string, horizon int, best_mae double"))
    assert names == ["h1", "h7", "h30"]
    assert sorted(r.run for r in runs.undominated(wide, names).collect()) == ["a", "b"]
    none = wide.limit(0)
    assert runs.undominated(none, names).count() == 0
