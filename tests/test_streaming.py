"""Streams over several arrivals: late rows, replays and batch equality."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.session import work_dir
from barline.streaming import feeds

SCHEMA = "id long, user string, ts timestamp, v double"
START = dt.datetime(2024, 1, 1)


def rows(*items):
    return [(i, u, START + dt.timedelta(minutes=m), float(i)) for i, u, m in items]


def land(spark, path, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def base(spark):
    return work_dir(spark, "stream-test")


def test_late_rows_are_dropped_and_windows_close_once(spark, base):
    for data in (rows((1, "a", 1), (2, "a", 9), (3, "a", 30)), rows((4, "a", 2), (5, "a", 60))):
        land(spark, f"{base}/in", data)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in").select(
            F.col("user").alias("ticker"), "ts", F.col("id").alias("event_id"), F.col("v").alias("price"),
            F.lit(1.0).alias("volume"))
        bars = feeds.closed_window(feeds.ohlc(stream, "10 minutes", delay="5 minutes"), "bar_ts")
        feeds.run_to_table(bars, f"{base}/out", f"{base}/ck")
    got = {r.bar_ts: (r.open, r.close, r.transactions) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {START: (1.0, 2.0, 2), START + dt.timedelta(minutes=30): (3.0, 3.0, 1)}


def test_upsert_replay_and_disorder_change_nothing(spark, base):
    each = feeds.upsert_into(f"{base}/table", "user", ["user"], ["ts", "id"])
    new, old = (spark.createDataFrame(rows((2, "a", 20), (3, "b", 5)), SCHEMA), spark.createDataFrame(rows((1, "a", 10)), SCHEMA))
    for number, batch in enumerate((new, old, new)):
        each(batch, number)
    assert {(r.user, r.id) for r in spark.read.parquet(f"{base}/table").collect()} == {("a", 2), ("b", 3)}


def test_duplicates_across_arrivals(spark, base):
    for data in (rows((1, "a", 1), (1, "a", 1)), rows((1, "a", 1), (2, "a", 3))):
        land(spark, f"{base}/in", data)
        stream = feeds.deduplicated(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"), ["id"])
        feeds.run_to_table(stream, f"{base}/out", f"{base}/ck")
    assert sorted(r.id for r in spark.read.parquet(f"{base}/out").collect()) == [1, 2]


def test_sliding_windows_equal_batch(spark, base):
    land(spark, f"{base}/in", rows(*[(i, "a", i * 7) for i in range(30)]))
    def shaped(df):
        return df.select(F.col("user").alias("ticker"), "ts", F.col("id").alias("event_id"), F.col("v").alias("price"),
                         F.lit(1.0).alias("volume"))
    stream = feeds.ohlc(shaped(spark.readStream.schema(SCHEMA).parquet(f"{base}/in")), "1 hour", "15 minutes", "5 minutes")
    feeds.run_to_table(stream, f"{base}/out", f"{base}/ck")
    batch = feeds.ohlc(shaped(spark.read.schema(SCHEMA).parquet(f"{base}/in")), "1 hour", "15 minutes", "5 minutes")
    closed = batch.where(F.col("window.end") <= F.lit(START + dt.timedelta(minutes=29 * 7 - 5)))
    assert sorted(spark.read.parquet(f"{base}/out").collect()) == sorted(closed.collect())


def test_stream_indicators_skip_missing_closes():
    """State handed from batch to batch gives what one pass over the series gives."""
    from barline.streaming.indicators import BarIndicators

    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def put(self, value):
            self.value = value

        update = put

    class Handle:
        def getListState(self, *_):  # noqa: N802
            return Held()

        getValueState = getListState  # noqa: N815

    rng = np.random.default_rng(1)
    close = rng.normal(50, 5, 300)
    close[rng.random(300) < 0.2] = np.nan
    close[100:140] = np.nan
    bars = pd.DataFrame({"ts": pd.date_range("2020", periods=300), "close": close, "volume": 1.0})
    state, out, at = BarIndicators(), [], 0
    state.init(Handle())
    while at < 300:
        size = int(rng.integers(1, 20))
        out += state.handleInputRows(("A",), iter([bars.iloc[at:at + size]]), None)
        at += size
    assert not list(state.handleInputRows(("A",), iter([bars.iloc[5:9]]), None))
    got = pd.concat(out).reset_index(drop=True)
    np.testing.assert_allclose(got.sma_10, bars.close.rolling(10).mean(), rtol=1e-9)
    np.testing.assert_allclose(got.ema_12, bars.close.ewm(span=12, adjust=False, min_periods=12).mean(), rtol=1e-9)


def _live_bars():
    """Eleven years of two series with missing closes and volumes, a long gap among them."""
    rng = np.random.default_rng(5)
    frames = []
    for ticker in ("A", "B"):
        close = rng.normal(0, 1, 4000).cumsum() + 500
        close[rng.random(4000) < 0.1] = np.nan
        close[2000:2300] = np.nan
        frames.append(pd.DataFrame({"ticker": ticker, "frequency": "daily", "ts": pd.date_range("2010-01-01", periods=4000),
                                    "open": close, "high": close + 1, "low": close - 1, "close": close,
                                    "volume": np.where(rng.random(4000) < 0.02, np.nan, rng.integers(1, 99, 4000).astype(float))}))
    return pd.concat(frames, ignore_index=True)


def _frame(spark, part):
    rows = [[None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in row] for row in part.itertuples(index=False)]
    return spark.createDataFrame(rows, LIVE_SCHEMA)


def _same(spark, path, bars):
    from barline.operators import indicators as I
    batch = I.indicator_set(_frame(spark, bars)).toPandas().sort_values(["ticker", "ts"])
    kept = spark.read.parquet(f"{path}/rows").toPandas().sort_values(["ticker", "ts"])
    assert len(kept) == len(batch)
    for name in I.STORED:
        np.testing.assert_allclose(kept[name].to_numpy(float), batch[name].to_numpy(float), rtol=1e-7, atol=1e-7, err_msg=name)


LIVE_SCHEMA = "ticker string, frequency string, ts timestamp, open double, high double, low double, close double, volume double"


def test_stored_indicators_equal_batch_with_late_files(spark, base):
    from barline.streaming.stored import indicators_into, ledger

    bars = _live_bars()
    each = indicators_into(f"{base}/live")
    day, n = bars["ts"], {}
    late = (day >= "2013-05-01") & (day < "2013-05-20")
    only_b = (day >= "2020-06-01") & (bars["ticker"] == "A")
    turns = [(day < "2020-01-01") & ~late, (day >= "2020-01-01") & ~only_b, late, only_b]
    for number, turn in enumerate(turns):
        part = bars[turn]
        if number == 3:  # a bar sent twice and bars without a key or a time
            part = pd.concat([part, part.iloc[:1], part.iloc[:1].assign(ticker=None), part.iloc[:1].assign(ts=pd.NaT)])
        n[number] = int(turn.sum())
        each(_frame(spark, part), number)
    _same(spark, f"{base}/live", bars)
    got = {r.batch_id: r for r in ledger(spark, f"{base}/live").collect()}
    assert {k: r.n_rows for k, r in got.items()} == n
    assert [got[k].n_late for k in range(4)] == [0, 0, int(late.sum()), 0]
    after = (day >= "2013-05-20") & ~only_b
    assert [got[k].n_corrected for k in range(4)] == [0, 0, int(after.sum()), 0]
    assert [got[k].n_skipped for k in range(4)] == [0, 0, 0, 2]


def test_stored_indicators_survive_a_crash_before_the_commit(spark, base):
    from barline.sources.writers import delete_folder
    from barline.streaming import stored

    bars = _live_bars()
    frame = {k: _frame(spark, p)
             for k, p in enumerate((bars[bars.index % 2 == 0], bars[bars.index % 2 == 1]))}
    each = stored.indicators_into(f"{base}/live")
    each(frame[0], 0)
    real, stored.delete_folder = stored.delete_folder, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        with pytest.raises(RuntimeError):
            each(frame[1], 1)
    finally:
        stored.delete_folder = real
    before = stored.ledger(spark, f"{base}/live").where("batch_id = 1").first()
    delete_folder(spark, f"{base}/live/commits/batch_id=1")  # as if the driver had gone just before
    each(frame[1], 1)
    each(frame[1], 1)
    assert stored.ledger(spark, f"{base}/live").where("batch_id = 1").first() == before
    _same(spark, f"{base}/live", bars)


def test_stored_indicators_of_nothing(spark, base):
    from barline.streaming import stored

    each = stored.indicators_into(f"{base}/live", ["obv"])
    each(spark.createDataFrame([], LIVE_SCHEMA), 0)
    assert tuple(stored.ledger(spark, f"{base}/live").first())[:4] == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        stored.indicators_into(f"{base}/live", ["rsi_14"])
