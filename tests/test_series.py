"""Blocked windows must equal plain per-series windows, whatever the block size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.operators import describe as D
from barline.operators import indicators as I
from barline.operators import missing
from barline.operators import series as S


def bars_frame(n=400, tickers=("A", "B"), holes=0.2, seed=3):
    rng = np.random.default_rng(seed)
    frames = []
    for t in tickers:
        close = rng.lognormal(3, 0.4, n)
        close[rng.random(n) < holes] = np.nan
        frames.append(pd.DataFrame({
            "ticker": t, "frequency": "1d", "ts": pd.date_range("1990-01-01", periods=n, freq="D"),
            "close": close, "volume": rng.integers(1, 50, n).astype(float), "high": close, "low": close}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def data(spark):
    pdf = bars_frame()
    df = spark.createDataFrame(pdf).withColumn("close", F.nanvl("close", F.lit(None).cast("double")))
    return pdf, df.withColumn("dt", F.to_date("ts")).persist()


def same(left, right):
    columns = sorted(left.columns)
    a = left.select(*columns).toPandas().sort_values(["ticker", "ts"]).reset_index(drop=True)
    b = right.select(*columns).toPandas().sort_values(["ticker", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-12)


@pytest.mark.parametrize("block", [1, 7, 64, 65_536])
def test_running_equals_plain_windows(data, block):
    _, df = data
    w = Window.partitionBy("ticker", "frequency").orderBy("ts")
    through, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    got = S.running(df, S.bars(block), sums={"s": F.col("volume")}, lasts={"l": F.col("close")},
                    mins={"m": F.col("close")}, nexts={"n": F.col("close")}, before_row=("m",))
    want = df.withColumns({
        "s": F.sum("volume").over(through), "l": F.last("close", True).over(through),
        "m": F.min("close").over(w.rowsBetween(Window.unboundedPreceding, -1)), "n": F.first("close", True).over(ahead)})
    same(got, want)


@pytest.mark.parametrize("block", [5, 33, 65_536])
def test_blocks_equal_plain_windows(data, block):
    _, df = data
    w = Window.partitionBy("ticker", "frequency").orderBy("ts")
    got = S.over_blocks(df, S.bars(block), [S.columns(
        a=lambda b: F.avg("close").over(b.rowsBetween(-4, 0)), f=lambda b: F.lead("close", 3).over(b))], before=4, after=3)
    want = df.withColumns({"a": F.avg("close").over(w.rowsBetween(-4, 0)), "f": F.lead("close", 3).over(w),
                           "pos": F.row_number().over(w)})
    same(got, want)


@pytest.mark.parametrize("block", [50, 65_536])
def test_exponential_averages_equal_pandas(data, block):
    pdf, df = data
    names = ["ema_12", "ema_26", "macd_signal"]
    got = I.indicator_set(df, names, S.bars(block)).toPandas().sort_values(["ticker", "ts"]).reset_index(drop=True)
    by = pdf.sort_values(["ticker", "ts"]).reset_index(drop=True).groupby("ticker").close
    fast = by.transform(lambda c: c.ewm(span=12, adjust=False, min_periods=12).mean())
    slow = by.transform(lambda c: c.ewm(span=26, adjust=False, min_periods=26).mean())
    signal = (fast - slow).groupby(pdf.ticker).transform(lambda c: c.ewm(span=9, adjust=False, min_periods=9).mean())
    for name, want in zip(names, (fast, slow, signal)):
        np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-9)


def test_wilder_rsi_equals_pandas(data):
    pdf, df = data
    full = df.withColumn("close", F.coalesce("close", F.lit(20.0)))
    got = I.indicator_set(full, ["rsi_14"], S.bars(100)).toPandas().sort_values(["ticker", "ts"]).rsi_14.to_numpy(float)

    def rsi(c):
        d = c.fillna(20.0).diff()
        up = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        down = (-d).clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        return 100 * up / (up + down)

    want = pdf.sort_values(["ticker", "ts"]).groupby("ticker").close.transform(rsi).to_numpy(float)
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_obv_crosses_blocks(data):
    _, df = data
    same(I.indicator_set(df, ["obv"], S.bars(9)), I.indicator_set(df, ["obv"]))


@pytest.mark.parametrize("block", [4, 65_536])
def test_fills_across_blocks(data, block):
    pdf, df = data
    got = missing.ffill_limit(df, S.bars(block), ["close"], 2).toPandas().sort_values(["ticker", "ts"]).close
    want = pdf.sort_values(["ticker", "ts"]).groupby("ticker").close.ffill(limit=2)
    np.testing.assert_array_equal(got.to_numpy(float), want.to_numpy(float))


def test_one_hot_series_is_spread_over_tasks(spark):
    rows = spark.range(20_000).select(
        F.lit("HOT").alias("ticker"), F.lit("1d").alias("frequency"),
        F.timestamp_seconds(F.col("id") * 86_400).alias("ts"), F.col("id").cast("double").alias("close"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = S.over_blocks(rows, S.bars(500), [S.columns(m=lambda w: F.avg("close").over(w.rowsBetween(-9, 0)))], before=9)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 4 and max(sizes) < 10_000


@pytest.mark.parametrize("method", ["cont", "disc"])
def test_quantiles_beyond_the_sketch_bound(spark, method):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 30_000), np.full(15_000, 0.25)])
    df = spark.createDataFrame(pd.DataFrame({"k": "hot", "v": values})).unionByName(
        spark.createDataFrame(pd.DataFrame({"k": "small", "v": [1.0, 2.0, 4.0]})))
    probs = [0.0, 0.1, 0.5, 0.55, 0.999, 1.0]
    got = {r.k: [r[f"q{i}"] for i in range(len(probs))] for r in D.quantiles(df, ["k"], "v", probs, method).collect()}
    kind = "linear" if method == "cont" else "inverted_cdf"
    np.testing.assert_allclose(got["hot"], np.quantile(values, probs, method=kind), rtol=1e-12)
    np.testing.assert_allclose(got["small"], np.quantile([1.0, 2.0, 4.0], probs, method=kind))


def _gapped(n=3000, gap=2000):
    rng = np.random.default_rng(3)
    close = 50 + rng.normal(0, 1, n).cumsum()
    close[500:500 + gap] = np.nan
    close[10:14] = np.nan
    return pd.DataFrame({"ticker": "T", "frequency": "1d", "ts": pd.date_range("2000-01-01", periods=n), "close": close})


@pytest.mark.parametrize("block", [64, 700, 65_536])
def test_averages_do_not_depend_on_blocks(spark, block):
    """Across, inside and after a gap of 2,000 rows, whatever the block size."""
    pdf = _gapped()
    df = spark.createDataFrame(pdf).withColumn("close", F.nanvl("close", F.lit(None).cast("double"))).repartition(3)
    names = ["ema_12", "ema_26", "macd_signal", "rsi_14"]
    got = I.indicator_set(df, names, S.bars(block)).toPandas().sort_values("ts")
    fast, slow = (pdf.close.ewm(span=n, adjust=False, min_periods=n).mean() for n in (12, 26))
    d = pdf.close.diff()
    up, down = (x.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (d, -d))
    want = {"ema_12": fast, "ema_26": slow, "macd_signal": (fast - slow).ewm(span=9, adjust=False, min_periods=9).mean(),
            "rsi_14": 100 * up / (up + down)}
    for name in names:
        np.testing.assert_allclose(got[name].to_numpy(float), want[name].to_numpy(float), rtol=1e-9, atol=1e-9)
    assert got.ema_26.isna().sum() == slow.isna().sum() < 40


def test_averages_of_single_row_blocks(spark):
    """Blocks of one row, several series, missing keys and series that begin with NULLs."""
    rng = np.random.default_rng(4)
    rows = [(t, k, None if rng.random() < 0.3 or (t == "b" and k < 6) else float(rng.normal()), f"x{k}") for t in ("a", "b", None) for k in range(1, 40)]
    df = spark.createDataFrame(rows, "ticker string, pos long, v double, extra string").repartition(4)
    series = S.Series(("ticker",), ("pos",), 1)
    out = I.exponential(df, series, [I.Ewm("y", "v", 0.2, 3), I.Ewm("z", "v", 1.0, 1)])
    assert out.columns == [*df.columns, "y", "z"]
    got = out.toPandas().sort_values(["ticker", "pos"], na_position="last").reset_index(drop=True)
    want = pd.DataFrame(rows, columns=["ticker", "pos", "v", "extra"]).sort_values(["ticker", "pos"], na_position="last").reset_index(drop=True)
    by = want.groupby("ticker", dropna=False).v
    np.testing.assert_allclose(got.y, by.transform(lambda c: c.ewm(alpha=0.2, adjust=False, min_periods=3).mean()), rtol=1e-12)
    np.testing.assert_allclose(got.z, by.transform(lambda c: c.ffill()), rtol=1e-12)
    assert out.limit(0).count() == 0 and I.exponential(df.limit(0), series, [I.Ewm("y", "v", 0.2, 3)]).count() == 0
