"""Yardstick models against brute force, and parameter draws."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import baseline as B
from barline.operators import joins as J


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (600, 2)).astype(float)
    y = np.where(x[:, 0] > 11, 5.0, -2.0) + 0.1 * x[:, 1]
    split = np.where(np.arange(600) < 400, "train", np.where(np.arange(600) < 500, "val", "test"))
    data = [(str(s), float(a), float(b), float(t), None if i % 7 == 0 else float(t)) for i, (s, (a, b), t) in enumerate(zip(split, x, y))]
    frame = spark.createDataFrame(data, "split string, a double, b double, target_1 double, target_2 double")
    return B.assemble(frame, ["a", "b"]), x, y, split


def _stump(x, y):
    """Both sides' means of the split that leaves the least squared error."""
    best = None
    for k in range(x.shape[1]):
        for cut in np.unique(x[:, k])[:-1]:
            low = x[:, k] <= cut
            error = ((y[low] - y[low].mean()) ** 2).sum() + ((y[~low] - y[~low].mean()) ** 2).sum()
            if best is None or error < best[0]:
                best = (error, k, cut, y[low].mean(), y[~low].mean())
    return best[1:]


def test_a_tree_of_depth_one_equals_brute_force(rows):
    frame, x, y, split = rows
    got = {r.split: r.mae for r in B.fit_score(frame, [1], "tree", maxDepth=1, maxBins=64).collect()}
    train = split == "train"
    k, cut, low, high = _stump(x[train], y[train])
    for name in ("train", "val", "test"):
        at = split == name
        assert got[name] == pytest.approx(np.abs(y[at] - np.where(x[at, k] <= cut, low, high)).mean())


def test_rows_and_scores_of_each_horizon(rows):
    frame, _, y, split = rows
    counted = {(r.split, r.horizon): r.n_rows for r in B.scored_rows(frame, [1, 2]).collect()}
    labelled = np.arange(600) % 7 != 0
    assert counted == {(s, h): int(((split == s) & (labelled | (h == 1))).sum()) for s in ("train", "val", "test") for h in (1, 2)}
    for model in ("linear", "boosted"):
        scored = {(r.split, r.horizon): (r.n, r.mae) for r in B.fit_score(frame, [1, 2], model).collect()}
        assert {k: n for k, (n, _) in scored.items()} == counted
        assert all(mae < np.abs(y - y.mean()).mean() for _, mae in scored.values())


def test_linear_draws_equal_ridge(spark, rows):
    frame, x, y, split = rows
    draws = spark.createDataFrame([(0.5, 0.0), (0.5, 0.0), (0.01, 0.0)], "reg double, mix double")
    got = {r.reg_param: r.val_mae for r in B.draw_fit(frame, "target_1", draws, "reg", "mix").collect()}
    train, val = split == "train", split == "val"
    scale, y_scale = x[train].std(axis=0, ddof=1), y[train].std(ddof=1)
    for reg, mae in got.items():
        # Spark ML penalises coefficients of standardised features and label.
        z = (x[train] - x[train].mean(axis=0)) / scale
        w = np.linalg.solve(z.T @ z / len(z) + reg / y_scale * np.eye(2), z.T @ (y[train] - y[train].mean()) / len(z))
        yhat = (x[val] - x[train].mean(axis=0)) / scale @ w + y[train].mean()
        assert mae == pytest.approx(np.abs(y[val] - yhat).mean(), rel=1e-3)
    assert len(got) == 2


def test_draws_are_portable_and_independent(spark):
    base = spark.createDataFrame([("r1",), ("r2",), (None,)], "run string")
    some = J.parameter_draws(base, ["run"], 50, {"lr": (-5, -2)}, choices={"d": [1, 2, 4]}, seed=7)
    more = J.parameter_draws(base, ["run"], 60, {"lr": (-5, -2)}, {"p": (2.0, 3.0)}, {"d": [1, 2, 4]}, seed=7)
    first = {(r.run, r.draw): (r.lr, r.d) for r in some.collect()}
    rows = more.collect()
    again = {(r.run, r.draw): (r.lr, r.d) for r in rows if r.draw <= 50}
    assert first == again and len(first) == 150
    digest = int(hashlib.md5(b"7|lr|r1|3").hexdigest()[:12], 16) / 2 ** 48
    assert first["r1", 3][0] == pytest.approx(10 ** (-5 + 3 * digest), rel=1e-12)
    assert all(1e-5 <= r.lr < 1e-2 and 2 <= r.p < 3 for r in rows) and {r.d for r in rows} == {1, 2, 4}
    assert J.parameter_draws(base, ["run"], 0, {"lr": (-5, -2)}).count() == 0
    assert J.parameter_draws(base.where(F.lit(False)), ["run"], 5, {"lr": (-5, -2)}).count() == 0
