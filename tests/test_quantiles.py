"""Quantiles by distributed selection against numpy: every group size, ties, missing keys, narrow brackets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import describe as D

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def _check(got, values, method):
    kind = "linear" if method == "cont" else "inverted_cdf"
    np.testing.assert_allclose(got, np.quantile(values, PROBS, method=kind), rtol=1e-12, atol=1e-300)


@pytest.mark.parametrize("method", ["cont", "disc"])
@pytest.mark.parametrize("most", [D.MOST, 3])
def test_groups_of_every_size(spark, monkeypatch, method, most):
    monkeypatch.setattr(D, "BINS", 4)
    rng = random.Random(1)
    groups = {n: [rng.choice((float(rng.randrange(5)), rng.random(), 1e9 * rng.random() ** 9)) for _ in range(n)] for n in (1, 2, 3, 4, 5, 7, 10, 11, 50, 999)}
    groups[None] = [3.0, 1.0, 2.0]
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(5, None), (77, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    got = {r.k: [r[f"q{i}"] for i in range(len(PROBS))] for r in D.quantiles(df, ["k"], "v", PROBS, method, most).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        _check(got[k], values, method)


@pytest.mark.parametrize("method", ["cont", "disc"])
def test_a_million_distinct_values_in_one_group(spark, method):
    """No task ranks more values than it is told to, whatever the size of a group."""
    values = spark.range(1_000_000).select((F.pmod(F.xxhash64("id"), F.lit(10 ** 12)) / 7.0).alias("v"), F.lit("hot").alias("k"))
    want = np.array([r.v for r in values.collect()])
    got = D.quantiles(values, ["k"], "v", PROBS, method, most=50).first()
    _check([got[f"q{i}"] for i in range(len(PROBS))], want, method)
    got = D.quantiles(values, [], "v", PROBS, method, most=50).first()
    _check([got[f"q{i}"] for i in range(len(PROBS))], want, method)


def test_brackets_narrow_to_the_bound(spark):
    n, rank = 20_000, 12_345
    values = spark.range(n).select(F.lit(0).alias("g"), F.pow(F.col("id").cast("double"), 5.0).alias("__x"), F.lit(1).cast("long").alias("__k"))
    targets = spark.createDataFrame([(0, 0.0, rank, 0, None, None, 0.0, float(n - 1) ** 5)],
                                    "g int, __frac double, __rank long, __below long, __under double, __over double, __lo double, __hi double")
    left, moved = D.select_ranks(values, targets, ["g"], most=10, bins=16)
    kept, target = sorted(r["__x"] for r in left.collect()), moved.first()
    assert len(kept) <= 10 and kept[rank - target["__below"] - 1] == float(rank - 1) ** 5
    assert target["__under"] < kept[0] and target["__over"] > kept[-1]


def test_no_rows(spark):
    none = spark.createDataFrame([], "k int, v double")
    assert D.quantiles(none, ["k"], "v", PROBS).count() == 0 and D.describe(none, ["k"], "v").count() == 0
