"""Commit ledgers, late rows, datasets that are checked when read, day partitions and correlations of wide tables."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import features as Q
from barline.session import work_dir
from barline.sources import readers, writers
from barline.streaming import feeds

DAY = dt.date(2024, 1, 1)


def _rows(spark, *rows):
    return spark.createDataFrame([(k, DAY + dt.timedelta(days=d), v) for k, d, v in rows], "k string, dt date, v long")


def _table(spark, path):
    return sorted((r.k, (r.dt - DAY).days, r.v) for r in spark.read.parquet(path).collect())


def test_a_replayed_batch_changes_nothing(spark, monkeypatch):
    path = f"{work_dir(spark, 'ledger')}/table"
    first, second = _rows(spark, ("a", 0, 1), ("b", 1, 1), ("b", 1, 2)), _rows(spark, ("a", 0, 5), ("c", 1, 3))
    each = feeds.upsert_into(path, "dt", ["k", "dt"], ["v"])
    each(first, 0)
    each(second, 1)
    want = [("a", 0, 5), ("b", 1, 2), ("c", 1, 3)]
    assert _table(spark, path) == want
    assert sorted(map(tuple, feeds.commits(spark, path).collect())) == [(0, 2), (1, 2)]
    # Were batch 0 done again, the row it would add shows.
    each(_rows(spark, ("z", 0, 9)), 0)
    assert _table(spark, path) == want

    # A crash after the rewrite and before the ledger: the batch is done again, with the same result.
    third, real = _rows(spark, ("a", 0, 9), ("d", 3, 1)), feeds.rewrite_partitions

    def crash(*args, **named):
        real(*args, **named)
        raise RuntimeError("lost")

    monkeypatch.setattr(feeds, "rewrite_partitions", crash)
    with pytest.raises(RuntimeError):
        each(third, 2)
    assert feeds.commits(spark, path).count() == 2
    monkeypatch.setattr(feeds, "rewrite_partitions", real)
    each(third, 2)
    each(third, 2)
    assert _table(spark, path) == [("a", 0, 9), ("b", 1, 2), ("c", 1, 3), ("d", 3, 1)]
    each(first.limit(0), 3)
    assert sorted(map(tuple, feeds.commits(spark, path).collect())) == [(0, 2), (1, 2), (2, 2), (3, 0)]


def test_batch_folders_are_removed(spark):
    base = os.path.dirname(work_dir(spark, "x"))
    before = {n for n in os.listdir(base) if n.startswith("batch-")}
    feeds.upsert_into(f"{work_dir(spark, 'ledger')}/table", "dt", ["k", "dt"], ["v"])(_rows(spark, ("a", 0, 1)), 0)
    assert {n for n in os.listdir(base) if n.startswith("batch-")} == before


def test_late_rows_are_counted_and_kept(spark):
    at = lambda *m: spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k) if k is not None else None, k) for k in m], "ts timestamp, n long")
    path = work_dir(spark, "late")
    each = feeds.watch_late(path, "1 hour", "15 minutes")
    assert feeds.late_counts(spark, path).count() == 0
    each(at(0, 5, 100, None), 0)
    each(at(16, 26, 61, 120), 1)  # intervals that end by minute 40 are late
    each(at(16, 26, 61, 120), 1)
    each(at(46, 59, 60), 2)  # by minute 60
    got = {int((r.ts - dt.datetime(2024, 1, 1)).total_seconds() // 60): (r.on_time, r.late) for r in feeds.late_counts(spark, path).collect()}
    assert got == {0: (2, 0), 90: (1, 0), 15: (0, 2), 60: (2, 0), 120: (1, 0), 45: (0, 2)}
    late = feeds.read_batches(spark, path, "late", "ts timestamp, n long")
    assert sorted((r.n, r.batch_id) for r in late.collect()) == [(16, 1), (26, 1), (46, 2), (59, 2)]


def test_a_dataset_is_checked_when_read(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 1 + k), [[float(k), 1.0]], [0.5], "train" if k < 5 else "test") for k in range(8)],
                                 "dt date, x array<array<double>>, y array<double>, split string")
    scaler = spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.0, 1.0)], "feature string, mean double, std double")
    base = work_dir(spark, "datasets")
    folder = f"{base}/seq/v1"
    write = lambda: writers.write_dataset(spark, rows, base, "seq", "v1", ["a", "b"], 1, [1], scaler)
    write()
    back, fit, manifest = writers.read_dataset(spark, folder)
    assert back.count() == 8 and manifest.first().n_train == 5
    assert sorted(map(tuple, fit.collect())) == [("a", 1.0, 2.0), ("b", 0.0, 1.0)]
    rows.where("split = 'test'").drop("split").limit(1).write.mode("append").parquet(f"{folder}/sequences/split=test")
    with pytest.raises(ValueError, match="differ from its list"):
        writers.read_dataset(spark, folder)
    write()
    assert writers.read_dataset(spark, folder)[0].count() == 8
    writers.delete_folder(spark, f"{folder}/manifest")
    with pytest.raises(ValueError, match="no manifest"):
        writers.read_dataset(spark, folder)


def test_articles_by_day_open_their_folders_only(spark):
    path = work_dir(spark, "articles")
    rows = spark.range(2000).select(F.col("id").alias("article_id"), F.timestamp_seconds(F.col("id") * 1800 + 1_704_067_200).alias("ts"))
    writers.write_articles(rows, path)
    got = readers.scan_article_days(spark, path, "2024-01-05", "2024-01-06")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and got.count() == 96
    assert len({os.path.dirname(f) for f in (r[0] for r in got.select(F.input_file_name()).distinct().collect())}) == 2


def test_correlations_of_three_hundred_features(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 300)) + 1e6 * np.arange(300)
    base[:, 7] = 3.0
    base[:, 20] = base[:, 3] * 2 + rng.normal(size=400) * 0.01
    base[rng.random(base.shape) < 0.03] = np.nan
    names = [f"f.{k}" for k in range(300)]
    frame = spark.createDataFrame(pd.DataFrame(base, columns=names)).select(*(F.nanvl(F.col(f"`{n}`"), F.lit(None).cast("double")).alias(n) for n in names)).repartition(5)
    got = {(r.a, r.b): r["corr"] for r in Q.correlations(frame, names).collect()}
    want = pd.DataFrame(base, columns=names).corr()
    assert len(got) == 300 * 299 // 2
    for (a, b), value in got.items():
        if "f.7" in (a, b):
            assert value is None or abs(value) > 1 or np.isfinite(value)
        else:
            assert abs(value - want.loc[a, b]) < 1e-7
    assert Q.correlations(frame, names[:1]).count() == 0 and Q.correlations(frame.limit(0), names[:2]).count() <= 1
