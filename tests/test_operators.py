"""Hand-made rows for the cases where a naive version goes wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barline.functions import numeric, text, timeops
from barline.operators import evaluate as E
from barline.operators import features as Q
from barline.operators import filters
from barline.operators import indicators as I
from barline.operators import joins as J
from barline.operators import merge as M
from barline.operators import missing
from barline.operators import quality
from barline.operators import runs
from barline.operators import sentiment as N
from barline.operators import series as S
from barline.operators import warmup
from barline.session import work_dir
from barline.sources import writers


def day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def bars(spark, closes, ticker="A", volumes=None):
    rows = [(ticker, "1d", day(i), day(i).date(), c, float(v)) for i, (c, v) in
            enumerate(zip(closes, volumes or [10] * len(closes)))]
    return spark.createDataFrame(rows, "ticker string, frequency string, ts timestamp, dt date, close double, volume double")


def values(df, name, order="ts"):
    return [r[name] for r in df.orderBy("ticker", order).select(name).collect()]


def test_zero_close_gives_no_return(spark):
    assert values(I.indicator_set(bars(spark, [0.0, 5.0, 10.0]), ["returns"]), "returns") == [None, None, 1.0]


def test_window_needs_all_its_values(spark):
    assert values(I.indicator_set(bars(spark, [1.0, 2.0, 3.0, 4.0]), ["sma_5"]), "sma_5") == [None] * 4


def test_no_value_crosses_tickers(spark):
    both = bars(spark, [1.0, 2.0], "A").unionByName(bars(spark, [None, 9.0], "B"))
    assert values(I.indicator_set(both, ["returns"]), "returns") == [None, 1.0, None, None]
    assert values(missing.ffill_limit(both, S.bars(), ["close"], 5), "close") == [1.0, 2.0, None, 9.0]
    assert values(missing.ffill(both, S.bars(), ["close"]), "close") == [1.0, 2.0, None, 9.0]


def test_limited_fill_stops(spark):
    assert values(missing.ffill_limit(bars(spark, [7.0] + [None] * 8), S.bars(), ["close"], 5), "close") == [7.0] * 6 + [None] * 3


def test_obv_ignores_missing_close(spark):
    df = bars(spark, [10.0, None, 12.0, 11.0, 11.0], volumes=[1, 2, 4, 8, 16])
    assert values(I.indicator_set(df, ["obv"]), "obv") == [1.0, 1.0, 1.0, -7.0, -7.0]


def test_nan_and_infinity_become_null(spark):
    df = bars(spark, [float("nan"), float("inf"), 1.0])
    assert values(numeric.finite_columns(df, ["close"]), "close") == [None, None, 1.0]


def test_gap_drop_keeps_short_runs(spark):
    df = bars(spark, [1.0, None, 2.0, None, None, None, 3.0, None])
    assert len(values(missing.max_gap_drop(df, S.bars(), "close", 2), "close")) == 5


def test_interpolation_is_linear_and_open_ended(spark):
    df = bars(spark, [None, 1.0, None, None, 4.0, None])
    assert values(missing.interpolate(df, S.bars(), "close"), "close") == [None, 1.0, 2.0, 3.0, 4.0, None]


def test_weights_missing_or_zero(spark):
    rows = [("a", 1.0, None), ("b", 3.0, None)]
    schema = "source string, tone double, word_count long"

    def tone(data):
        df = spark.createDataFrame(data, schema).withColumns({c: F.col("tone") for c in ("positive", "negative", "polarity")})
        return df.agg(*N.sentiment_aggregates()).first()

    assert tone(rows).weighted_avg_tone == 2.0
    empty = tone([("a", 1.0, 0), ("b", 3.0, 0)])
    assert empty.weighted_avg_tone is None and empty.num_articles == 2


def test_tone_string_with_missing_fields(spark):
    df = text.parse_tone(spark.createDataFrame([("1,2,3,4,1,2",), ("x,2",), ("",)], "v2tone string"))
    got = df.select("tone", "positive", "word_count").collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0, None), (None, 2.0, None), (None, None, None)]


def test_topic_match_is_literal_and_list_length_does_not_matter(spark):
    df = spark.createDataFrame([("FOOD_PRICES;TAX",), ("FOODXPRICES",)], "v2themes string")
    assert filters.topic_filter(df, ["food prices"]).count() == 1
    assert filters.topic_filter(df, ["food prices"] + [f"t{i}" for i in range(40)]).count() == 1


def test_week_is_labelled_by_its_sunday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 23, 59),), (dt.datetime(2024, 1, 8, 0, 0),)], "ts timestamp")
    got = [r[0] for r in df.orderBy("ts").select(timeops.resample_label(F.col("ts"), "1w")).collect()]
    assert got == [dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 14)]


def test_weekend_gaps_are_classified_before_the_limit(spark):
    friday = dt.datetime(2024, 1, 5)
    stamps = [friday, friday + dt.timedelta(days=3), friday + dt.timedelta(days=4), friday + dt.timedelta(days=6)]
    df = spark.createDataFrame([("A", "1d", t) for t in stamps], "ticker string, frequency string, ts timestamp")
    gaps = quality.date_gaps(df, S.bars(), 48)
    assert sorted((r.gap_hours, r.weekend) for r in gaps.collect()) == [(48, False), (72, True)]
    assert [r.gap_hours for r in quality.largest_gaps(gaps, ["ticker"], 1).collect()] == [48]


def test_frequency_spellings_meet(spark):
    a = bars(spark, [1.0]).withColumn("frequency", F.lit("daily"))
    b = bars(spark, [1.0]).select("ticker", "ts", "frequency", F.lit(5.0).alias("sma_10"))
    assert J.join_bars_indicators(a, b).count() == 1


def test_dedupe_keeps_last_or_first(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), ("j", 1, "c")], "key string, at int, v string")
    assert {(r.key, r.v) for r in M.dedupe(df, ["key"], ["at"]).collect()} == {("k", None), ("j", "c")}
    assert {(r.key, r.v) for r in M.dedupe(df, ["key"], ["at"], "first").collect()} == {("k", "a"), ("j", "c")}


def test_merges_are_idempotent(spark):
    target = bars(spark, [1.0, 2.0, 3.0]).withColumn("ingested_at", F.lit(0))
    source = bars(spark, [None, 20.0, 30.0, 40.0]).withColumn("ingested_at", F.lit(1))
    for merge, want in ((M.merge_upsert, [None, 20.0, 30.0, 40.0]), (M.merge_coalesce, [1.0, 20.0, 30.0, 40.0]),
                        (M.merge_insert_only, [1.0, 2.0, 3.0, 40.0])):
        once = merge(target, source)
        assert values(once, "close") == want
        assert values(merge(once, source), "close") == want


def test_partition_rewrite_can_empty_a_partition(spark):
    path = work_dir(spark, "test")
    df = bars(spark, [1.0] * 4).withColumn("part", F.when(F.col("dt") < day(2).date(), "a").otherwise("b"))
    writers.write_truncate(df, path, ["part"])
    gone = F.col("dt") < day(2).date()
    writers.rewrite_partitions(spark, path, spark.read.parquet(path).where(gone), "part", lambda x: M.delete_where(x, gone))
    assert [r.part for r in spark.read.parquet(path).select("part").distinct().collect()] == ["b"]
    assert spark.read.parquet(path).count() == 2


def test_partition_rewrite_takes_special_and_missing_values(spark):
    path = work_dir(spark, "test")
    part = F.element_at(F.array(F.lit("a:b"), F.lit(None), F.lit("c d"), F.lit("e%2F")), F.dayofmonth("dt"))
    writers.write_truncate(bars(spark, [1.0, 2.0, 3.0, 4.0]).withColumns({"outer": F.lit("x"), "part": part}), path, ["outer", "part"])
    for gone, left in ((1.0, [2.0, 3.0, 4.0]), (2.0, [3.0, 4.0]), (4.0, [3.0])):
        test = F.col("close") == gone
        writers.change_rows(spark, path, test, lambda x: M.delete_where(x, test))
        assert values(spark.read.parquet(path), "close") == left
    with pytest.raises(ValueError):
        writers.rewrite_partitions(spark, path, spark.read.parquet(path), "part", lambda x: x)


def test_stored_merges(spark):
    for mode, want in (("upsert", [1.0, None, 30.0, 40.0]), ("coalesce", [1.0, 2.0, 30.0, 40.0]), ("insert", [1.0, 2.0, 3.0, 40.0])):
        path, staging = work_dir(spark, "test"), work_dir(spark, "test")
        writers.write_bars(bars(spark, [1.0, 2.0, 3.0]), path)
        new = bars(spark, [0.0, None, 30.0, 40.0]).where("dt > '2020-01-01'").withColumns(
            {"frequency": F.lit("daily"), "ingested_at": F.lit(2)})
        old = new.withColumns({"close": F.lit(-1.0), "ingested_at": F.lit(1)})
        new.unionByName(old).write.parquet(staging)
        for _ in range(2):
            writers.merge_into(spark, path, staging, mode)
            table = writers.read_table(spark, path)
            assert values(table, "close") == want and values(table.select("frequency", "ts"), "frequency") == ["1d"] * 4
        assert spark.read.parquet(staging).isEmpty()


def test_top_up_comes_before_skip(spark):
    work = spark.createDataFrame([("A", "1d"), ("B", "1d"), ("C", "1d")], "ticker string, frequency string")
    held = bars(spark, [1.0] * 3, "A").unionByName(bars(spark, [1.0] * 30, "B"))
    plan = {r.ticker: r for r in M.topup_plan(work, held, "2019-01-01", "2020-01-10").collect()}
    assert (plan["A"].action, plan["A"].start_ts) == ("top_up", day(3))
    assert (plan["B"].action, plan["C"].action) == ("skip", "load")


def test_split_sizes_and_order(spark):
    df = spark.createDataFrame([(day(i).date(),) for i in range(101)], "dt date")
    out = Q.time_split(df, S.daily((), block_rows=8))
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 70, "val": 15, "test": 16}
    assert all(r.ordered for r in Q.split_overlap(out).collect())


def test_row_weights_equal_materialised_windows(spark):
    n, lookback, far = 60, 5, 3
    df = spark.createDataFrame([(day(i).date(), float(i * i % 17), 4.0) for i in range(n)], "dt date, x double, flat double")
    rows = Q.number_samples(df, S.daily((), block_rows=7), lookback, far)
    fitted = Q.fit_standard(rows, ["x", "flat"], F.col("weight")).first()
    n_train = int((n - lookback - far) * 0.7)
    xs = [float(r * r % 17) for i in range(lookback, lookback + n_train) for r in range(i - lookback, i)]
    mean = sum(xs) / len(xs)
    std = (sum((x - mean) ** 2 for x in xs) / len(xs)) ** 0.5
    assert fitted.x.mean == pytest.approx(mean) and fitted.x.std == pytest.approx(std)
    assert (fitted.flat.mean, fitted.flat.std) == (4.0, 1.0)


def test_sequences_leave_the_row_itself_out(spark):
    df = bars(spark, [float(i) for i in range(1, 11)])
    out = Q.sequences(df, S.bars(4), ["close"], "close", 3, [1, 2]).orderBy("dt").collect()
    assert len(out) == 5
    assert [v[0] for v in out[0].x] == [1.0, 2.0, 3.0] and out[0].y == [0.25, 0.5]


def test_training_guard_raises(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", None)], "split string, x double")
    with pytest.raises(ValueError, match="x"):
        Q.assert_clean(Q.nan_inf_guard(df, ["x"]))


def test_zero_forecast_directions(spark):
    df = spark.createDataFrame([("A", 1, 7, 0.0, 0.0), ("A", 2, 7, 0.0, 0.0)],
                               "ticker string, sample_id long, horizon int, y double, yhat double")
    assert E.direction_sign(df).first().dir_acc == 100.0
    assert E.direction_positive(df).first().dir_acc == 1.0
    assert E.direction_diff(df, S.stepped(["ticker"], "sample_id")).first().dir_acc == 0.0


def test_early_stop_counts_steps_without_improvement(spark):
    losses = [5.0, 4.0, 4.0, 4.5, 3.0, 3.5, 3.6, 3.7, 1.0]
    df = spark.createDataFrame([("r", i * 10, v) for i, v in enumerate(losses)], "run string, step long, value double")
    for patience, want in ((3, (True, 70, 40, 3.0)), (9, (False, 80, 80, 1.0))):
        row = runs.early_stop(df, patience).first()
        assert (row.stopped, row.stop_step, row.best_step, row.best_value) == want


def test_asof_takes_latest_at_or_before(spark):
    left = spark.createDataFrame([("u", day(1), 1), ("u", day(5), 2), ("v", day(5), 3)], "k string, ts timestamp, id int")
    right = spark.createDataFrame([("u", day(1), 10.0), ("u", day(4), 40.0), ("u", day(6), 60.0)], "k string, ts timestamp, v double")
    out = J.asof_backward(left, right, ["k"], ["v"], S.timed(("k",), ("ts",)))
    assert {r.id: r.v_asof for r in out.collect()} == {1: 10.0, 2: 40.0, 3: None}


def test_registered_indicator_joins_the_set(spark):
    I.register(I.Indicator("half_close", 0, expr=lambda w: F.col("close") / 2))
    try:
        assert values(I.indicator_set(bars(spark, [4.0]), ["half_close"]), "half_close") == [2.0]
    finally:
        del I.CATALOG["half_close"]


def test_warmup_needs_follow_the_longest_indicator(spark):
    assert warmup.periods_needed(["sma_200", "returns"]) == 200
    assert warmup.periods_needed(["volatility_20"]) == 21
    assert (warmup.scan_days("daily", 200), warmup.scan_days("15m", 96)) == (245, 6)


def test_deletes_keep_rows_the_condition_does_not_decide(spark):
    df = spark.createDataFrame([("shop", "1d"), ("other", "1d"), (None, "1d")], "topic_group_id string, frequency string")
    assert M.delete_topic_group(df, "shop", "1d").count() == 2
    kept = M.delete_key_range(bars(spark, [1.0, 2.0, 3.0]), ["A"], "2020-01-02", "2020-01-02", "1d")
    assert values(kept, "close") == [1.0, 3.0]
    assert M.any_row(kept, F.col("close") == 3.0) and not M.any_row(kept, F.col("close") == 2.0)


def test_correlated_features_are_dropped_later_one_first(spark):
    df = spark.createDataFrame([(float(i), float(2 * i), float(i % 3)) for i in range(30)], "a double, b double, c double")
    assert Q.drop_correlated(df, ["a", "b", "c"]).columns == ["a", "c"]


def test_long_topic_lists_match_inside_themes(spark):
    from barline.operators import filters

    df = spark.createDataFrame([("ENV_OIL_PRICE;X",), ("ENV_GAS;Y",), (None,)], "v2themes string")
    many = ["oil", *[f"other {k}" for k in range(50)]]
    assert [r[0] for r in filters.topic_filter(df, many).collect()] == ["ENV_OIL_PRICE;X"]
    assert filters.topic_filter(df, []).count() == 0


def test_run_names_keep_small_values_apart(spark):
    from pyspark.sql import functions as F

    from barline.functions import text

    rows = spark.createDataFrame([(1e-7,), (2e-7,), (1.234567e-5,), (0.1,), (10.0,), (1e-30,), (0.0,)], "v double")
    named = rows.select("v", text.run_name("lr", {"lr": F.col("v")}).alias("name"))
    back = named.select("v", text.run_params(F.col("name"), ["lr"])["lr"].alias("read")).collect()
    assert all(r.v == r.read for r in back)
    assert len({r.name for r in named.collect()}) == 7
    assert text.run_params(F.lit("a_lr1e-05"), ["lr"]) is not None
    assert spark.range(1).select(text.run_params(F.lit("a_lr1e-05_wd2"), ["lr"])["lr"]).first()[0] == 1e-5


def test_null_keys_are_a_series(spark):
    from barline.operators import series as S

    df = spark.createDataFrame([(None, f"2024-01-0{k}") for k in range(1, 7)], "ticker string, d string").selectExpr(
        "ticker", "'1d' AS frequency", "cast(d AS timestamp) AS ts")
    got = S.with_position(df, S.bars(2)).orderBy("ts").collect()
    assert [r.pos for r in got] == [1, 2, 3, 4, 5, 6]


def test_repeated_staged_keys_count_once(spark):
    from barline.operators import merge

    target = spark.createDataFrame([("a", 1, 5)], "k string, v int, ingested_at int")
    source = spark.createDataFrame([("a", 2, 6), ("a", 3, 7), ("b", 4, 6)], "k string, v int, ingested_at int")
    for merged in (merge.merge_upsert(target, source, ["k"]), merge.merge_coalesce(target, source, ["k"])):
        assert sorted((r.k, r.v) for r in merged.collect()) == [("a", 3), ("b", 4)]


def test_frequency_spellings_meet(spark):
    from barline.operators import merge

    held = spark.createDataFrame([("A", "daily", "2024-01-05")], "ticker string, frequency string, d string").selectExpr(
        "ticker", "frequency", "cast(d AS timestamp) AS ts")
    work = spark.createDataFrame([("A", "1d")], "ticker string, frequency string")
    assert merge.exists_check(work, held).first().has_data
    assert merge.topup_plan(work, held, "2024-01-01", "2024-02-01").first().action == "top_up"


def test_checks_that_can_fail(spark):
    from barline.operators import features

    rows = spark.createDataFrame([("train", k) for k in range(600)], "split string, dt int")
    report = {r.split: r.enough for r in features.min_samples_check(rows).collect()}
    assert report == {"train": True, "val": False, "test": False}
    mixed = spark.createDataFrame([("train", 1), ("train", 9), ("test", 5)], "split string, dt int")
    assert {r.split: r.ordered for r in features.split_overlap(mixed).collect()} == {"train": True, "test": False}
    wide = spark.createDataFrame([(float(k), 2.0 * k, float(k * k % 7)) for k in range(20)], "a double, b double, c double")
    assert features.drop_correlated(wide, ["a", "b", "c"]).columns == ["a", "c"]
