"""Model-ready tables: targets, sequences, splits, scalers, checks (Q1-Q18)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import numeric, timeops
from barline.operators import describe as D
from barline.operators import filters, indicators, quality, reshape
from barline.operators import series as S
from barline.session import settle

# Features already on a bounded scale are never rescaled.
TIME_FEATURES = ("hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos", "is_weekend")
# Smallest acceptable number of rows per split.
MIN_SAMPLES = {"train": 500, "val": 100, "test": 100}


# --- the feature matrix ------------------------------------------------------

def matrix_features(tickers: Sequence[str], member_features: Sequence[str]) -> list[str]:
    """Column names of the tickers' own features, in the matrix' order."""
    return [f"{f}_{m}" for f in member_features for m in tickers]


def feature_matrix(bars: DataFrame, member_features: Sequence[str], basket: Sequence[str], frequency: str = "daily",
                   tickers: Sequence[str] | None = None, shared: DataFrame | None = None, shared_features: Sequence[str] = (),
                   logged: Sequence[str] = (), lags: Mapping[str, tuple[str, int]] | None = None, fill_rows: int = 5,
                   weekends: bool = False) -> DataFrame:
    """One row per period of ``frequency``: ``ts``, ``dt``, ``{feature}_{ticker}`` for every ticker, shared features,
    their lags, cyclic calendar columns, and ``basket_close``, the mean close of the basket's members.

    ``tickers`` are all of the table unless given; the basket need not be among them. Member features are columns of
    ``bars`` or indicators; their gaps are filled for at most ``fill_rows`` periods. ``logged`` shared features become
    ln(1 + x). ``lags`` names (feature, periods). Weekends are removed last, so that lags and fills count periods.
    """
    name = timeops.canonical(frequency)
    own = bars.where(F.col("frequency") == frequency)
    if tickers is None:
        # As many as there are columns to be made.
        tickers = sorted(r["ticker"] for r in own.select("ticker").distinct().collect() if r["ticker"] is not None)
    wanted = [f for f in member_features if f not in bars.columns]
    members = own.where(F.col("ticker").isin(list(tickers)))
    if wanted:
        members = indicators.indicator_set(members.select("ticker", "ts", "frequency", *dict.fromkeys(
            ["close", *(c for c in ("open", "high", "low", "volume") if c in bars.columns)])), wanted)
    # Long to wide first: shared series then join one row per period, not one per ticker.
    wide = reshape.pivot_features(members, list(tickers), list(member_features))
    if shared is not None:
        wide = wide.join(numeric.log1p_columns(shared, list(logged)).select("ts", *shared_features), "ts", "left")
    joined = wide.join(quality.basket_mean(own, basket).select("ts", "basket_close"), "ts", "left").withColumn("dt", F.to_date("ts"))
    filled = matrix_features(tickers, member_features)
    fill = {n: (lambda w, n=n: F.coalesce(n, F.last(n, True).over(w.rowsBetween(-fill_rows, -1)))) for n in filled}
    late = {n: (lambda w, c=c, k=k: F.lag(c, k).over(w)) for n, (c, k) in (lags or {}).items()}
    seconds = timeops.STEP_SECONDS[name]
    series = S.Series((), ("ts",), S.BLOCK_ROWS, lambda s: F.floor(F.unix_seconds("ts") / F.lit(seconds * s.block_rows)))
    before = max([fill_rows, *(k for _, k in (lags or {}).values())])
    rows = S.over_blocks(settle(joined, "joined"), series, [S.columns(**fill, **late)], before=before).drop("pos")
    timed = timeops.cyclical_encode(timeops.calendar_features(rows if weekends else filters.weekend_filter(rows)))
    calendar = [c for c in TIME_FEATURES if c in timed.columns]
    return timed.select("ts", "dt", *filled, *shared_features, *(lags or {}), *calendar, "basket_close")


# --- targets and sequences ---------------------------------------------------

def _ahead(price: str, h: int):
    return lambda w: F.try_divide(F.lead(price, h).over(w) - F.col(price), F.col(price))


def forward_returns(df: DataFrame, series: S.Series, price: str, horizons: Sequence[int],
                    keep_position: bool = False) -> DataFrame:
    """Relative change to the price ``h`` rows ahead, as ``target_{h}``; optionally with
    the row number as ``pos``."""
    cols = {f"target_{h}": _ahead(price, h) for h in horizons}
    out = S.over_blocks(df, series, [S.columns(**cols)], after=max(horizons))
    return out if keep_position else out.drop("pos")


def weighted_target(df: DataFrame, weights: Mapping[int, float], log: bool = False, name: str = "target") -> DataFrame:
    """Weighted sum of horizon returns (or log returns); NULL if any is missing."""
    total: Column = F.lit(0.0)
    for h, weight in weights.items():
        value = F.log1p(f"target_{h}") if log else F.col(f"target_{h}")
        total = total + value * F.lit(float(weight))
    return df.withColumn(name, total)


def sequences(df: DataFrame, series: S.Series, features: Sequence[str], price: str, lookback: int,
              horizons: Sequence[int], ts: str = "dt") -> DataFrame:
    """One sample per row with full history and future: ``x`` holds the ``lookback``
    rows before it (the row itself is not in ``x``), ``y`` its horizon returns."""
    far = max(horizons)
    step = S.columns(
        x=lambda w: F.collect_list("__row").over(w.rowsBetween(-lookback, -1)),
        y=lambda w: F.array(*[_ahead(price, h)(w) for h in horizons]),
        __far=lambda w: F.lead(F.lit(1), far).over(w))
    rows = df.withColumn("__row", F.array(*[F.col(f).cast("double") for f in features]))
    rows = rows.select(*dict.fromkeys([*series.keys, *series.order, ts, price]), "__row")
    out = S.over_blocks(rows, series, [step], before=lookback, after=far)
    return out.where((F.size("x") == lookback) & F.col("__far").isNotNull()).select(*series.keys, ts, "x", "y")


def sequences_simple(df: DataFrame, series: S.Series, features: Sequence[str], target: str, lookback: int,
                     stride: int = 1, ts: str = "dt") -> DataFrame:
    """``x`` holds the ``lookback`` rows before, ``y`` the row's own target; every ``stride``-th row."""
    rows = df.withColumn("__row", F.array(*[F.col(f).cast("double") for f in features]))
    rows = rows.select(*dict.fromkeys([*series.keys, *series.order, ts, target]), "__row")
    step = S.columns(x=lambda w: F.collect_list("__row").over(w.rowsBetween(-lookback, -1)))
    out = S.over_blocks(rows, series, [step], before=lookback)
    chosen = (F.size("x") == lookback) & ((F.col("pos") - lookback - 1) % stride == 0)
    return out.where(chosen).select(*series.keys, ts, "x", F.col(target).alias("y"))


# --- splits ------------------------------------------------------------------

def time_split(df: DataFrame, series: S.Series, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Chronological split by rank. ``series`` has no keys: its order is the global one.

    The rank comes from per-bucket counts, not from a single sorted partition.
    """
    ranked = S.with_position(df, series, "sample_no")
    n = df.agg(F.count("*")).scalar()
    return ranked.withColumn("split", split_label(F.col("sample_no"), n, train, val))


def number_samples(df: DataFrame, series: S.Series, lookback: int, far: int, train: float = 0.7,
                   val: float = 0.15, total: Column | None = None) -> DataFrame:
    """Row number, split of the sample predicted at the row, and its scaler weight.

    Samples are the rows with a full lookback before and ``far`` rows after them;
    other rows have no split but may still weigh in as history of training samples.
    An input that has its ``pos`` already is not numbered again, and ``total`` saves
    counting it.
    """
    rows = df if "pos" in df.columns else S.with_position(df, series)
    n = df.agg(F.count("*")).scalar() if total is None else total
    samples = F.greatest(n - (lookback + far), F.lit(0).cast("long"))
    rows = rows.withColumn("row_no", F.col("pos") - 1).drop("pos")
    index = F.col("row_no") - lookback
    is_sample = (index >= 0) & (index < samples)
    return rows.withColumns({
        "split": F.when(is_sample, split_label(index + 1, samples, train, val)),
        "weight": window_weight(F.col("row_no"), lookback, F.floor(samples * F.lit(train)))})


def split_label(position: Column, n: Column, train: float = 0.7, val: float = 0.15) -> Column:
    """``position`` counts from 1; boundaries are truncated as integers."""
    first, second = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + val))
    return F.when(position <= first, "train").when(position <= second, "val").otherwise("test")


def date_split(df: DataFrame, val_start: str, test_start: str, dt: str = "dt") -> DataFrame:
    d = F.col(dt).cast("date")
    return df.withColumn("split", F.when(d < F.lit(val_start).cast("date"), "train")
                         .when(d < F.lit(test_start).cast("date"), "val").otherwise("test"))


def min_samples_check(df: DataFrame, minimum: Mapping[str, int] | None = None) -> DataFrame:
    """Samples of every required split, also of one without any, and of any other split."""
    minimum = dict(minimum or MIN_SAMPLES)
    need = F.lit(0)
    for name, n in minimum.items():
        need = F.when(F.col("split") == name, n).otherwise(need)
    none = df.sparkSession.createDataFrame([(name, 0) for name in minimum], "split string, n long")
    counts = df.groupBy("split").agg(F.count("*").alias("n")).unionByName(none)
    return counts.groupBy("split").agg(F.sum("n").alias("n")).withColumn("required", need.cast("long")).withColumn(
        "enough", F.col("n") >= F.col("required"))


# --- scalers -----------------------------------------------------------------

def window_weight(row: Column, lookback: int, n_train: Column) -> Column:
    """In how many training windows row ``row`` (from 0) occurs.

    Fitting a scaler on flattened windows equals fitting it on rows with these
    weights, at a ``lookback``-th of the data.
    """
    last = F.least(row + lookback, n_train + (lookback - 1))
    first = F.greatest(row + 1, F.lit(lookback).cast("long"))
    return F.greatest(last - first + 1, F.lit(0).cast("long"))


def fit_standard(df: DataFrame, features: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Weighted mean and population deviation per feature, as one row of structs.

    Time features are left out; a constant feature gets deviation 1. The deviation
    is taken around the mean in a second pass, which stays accurate for features
    whose mean is large against their spread.
    """
    names = [f for f in features if f not in TIME_FEATURES]
    w = (F.lit(1) if weight is None else weight).cast("double")
    used = df.select(*names, w.alias("__w")).where(F.col("__w") > 0)

    def total(f: str) -> Column:
        return F.sum(F.when(F.col(f).isNotNull(), F.col("__w")))

    centres = used.agg(F.struct(*[
        F.when(F.min(f) == F.max(f), F.min(f)).otherwise(F.try_divide(F.sum(F.col(f) * F.col("__w")), total(f))).alias(f)
        for f in names])).scalar()
    aggs = []
    for f in names:
        off = F.col(f) - F.col("__c")[f]
        std = F.sqrt(F.try_divide(F.sum(off * off * F.col("__w")), total(f)))
        aggs.append(F.struct(F.first(F.col("__c")[f], True).alias("mean"),
                             F.when(F.coalesce(std, F.lit(0.0)) == 0, 1.0).otherwise(std).alias("std")).alias(f))
    return used.withColumn("__c", centres).agg(*aggs)


def scaler_table(fitted: DataFrame) -> DataFrame:
    """The fitted row as a (feature, mean, std) table."""
    parts = [F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`.mean").alias("mean"), F.col(f"`{f}`.std").alias("std"))
             for f in fitted.columns]
    return fitted.select(F.inline(F.array(*parts)))


def _apply(df: DataFrame, fitted: DataFrame, formula) -> DataFrame:
    names = fitted.columns
    row = fitted.select(F.struct(*[F.col(f"`{n}`") for n in names])).scalar()
    scaled = df.withColumn("__s", row)
    return scaled.withColumns({n: formula(F.col(n), F.col("__s")[n]) for n in names}).drop("__s")


def apply_standard(df: DataFrame, fitted: DataFrame) -> DataFrame:
    return _apply(df, fitted, lambda c, s: F.try_divide(c - s["mean"], s["std"]))


def inverse_standard(df: DataFrame, fitted: DataFrame) -> DataFrame:
    return _apply(df, fitted, lambda c, s: c * s["std"] + s["mean"])


def scale_standard_eps(df: DataFrame, train: DataFrame, features: Sequence[str], eps: float = 1e-8) -> DataFrame:
    fitted = train.agg(*[F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f) for f in features])
    return _apply(df, fitted, lambda c, s: (c - s["mean"]) / (s["std"] + eps))


def scale_minmax(df: DataFrame, train: DataFrame, features: Sequence[str], eps: float = 0.0) -> DataFrame:
    """To the training range; with ``eps`` the range is padded as a guard against zero."""
    fitted = train.agg(*[F.struct(F.min(f).alias("low"), F.max(f).alias("high")).alias(f) for f in features])
    return _apply(df, fitted, lambda c, s: F.try_divide(c - s["low"], s["high"] - s["low"] + eps))


def scale_robust(df: DataFrame, train: DataFrame, feature: str, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """(x - median) / interquartile range of the training rows of the same ticker."""
    q = D.quantiles(train, keys, feature, [0.25, 0.5, 0.75])
    return df.join(q, list(keys), "left").withColumn(
        feature, F.try_divide(F.col(feature) - F.col("q1"), F.col("q2") - F.col("q0"))).drop("q0", "q1", "q2")


def fit_target(train: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One mean and population deviation over all horizons together."""
    # Deviations are merged around running means, so large values do not cancel.
    mean, std = F.avg("v"), F.stddev_pop("v")
    one = F.struct(mean.alias("mean"), F.when(std == 0, 1.0).otherwise(std).alias("std"))
    return train.select(F.explode(F.array(*targets)).alias("v")).agg(one.alias("target"))


def apply_target(df: DataFrame, fitted: DataFrame, targets: Sequence[str]) -> DataFrame:
    row = fitted.select("target").scalar()
    return df.withColumn("__s", row).withColumns(
        {t: F.try_divide(F.col(t) - F.col("__s.mean"), F.col("__s.std")) for t in targets}).drop("__s")


# --- selection and checks ----------------------------------------------------

def nan_inf_guard(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    """NaN, infinite and missing values per split and feature."""
    inf = F.lit(float("inf"))
    aggs = [F.struct(
        F.lit(f).alias("feature"), F.count_if(F.isnan(F.col(f))).alias("n_nan"),
        F.count_if(F.abs(F.col(f)) == inf).alias("n_inf"), F.count_if(F.col(f).isNull()).alias("n_null")).alias(f)
        for f in features]
    grouped = df.groupBy(split).agg(*aggs)
    return grouped.select(split, F.inline(F.array(*[F.col(f"`{f}`") for f in features])))


def assert_clean(report: DataFrame) -> None:
    """Raise when the training split holds NaN, infinite or missing values."""
    bad = report.where((F.col("split") == "train") & (F.col("n_nan") + F.col("n_inf") + F.col("n_null") > 0))
    found = [r["feature"] for r in bad.select("feature").collect()]
    if found:
        raise ValueError(f"training features with missing or non-finite values: {', '.join(found)}")


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pairwise correlations (a before b in the given order) over the rows that have both values.

    Each task adds up products of whole batches (values, squares and marks of what is present) and sends one row a
    pair; these are summed by pair. Values are taken around the column means, which keeps the sums accurate.
    """
    names = list(features)
    left, right = np.triu_indices(len(names), 1)
    centres = df.agg(*[F.avg(F.col(f"`{f}`").cast("double")).alias(f"c{i}") for i, f in enumerate(names)]).first()
    middle = np.array([0.0 if c is None else c for c in centres])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(names), len(names)))
        for batch in batches:
            x = np.column_stack([np.asarray(c.fill_null(np.nan), float) for c in batch.columns]) - middle
            here = ~np.isnan(x)
            x, here = np.where(here, x, 0.0), here.astype(float)
            total += np.stack([here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x])
        n, s, q, p = total
        yield pa.RecordBatch.from_arrays(
            [pa.array(v[left, right]) for v in (n, s, s.T, q, q.T, p)] + [pa.array(left), pa.array(right)],
            ["n", "sa", "sb", "qa", "qb", "p", "i", "j"])

    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    parts = df.select(*[F.col(f"`{f}`").cast("double").alias(f"c{i}") for i, f in enumerate(names)]).mapInArrow(
        run, "n double, sa double, sb double, qa double, qb double, p double, i long, j long")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p")])
    spread = F.sqrt(F.expr("(qa - sa * try_divide(sa, n)) * (qb - sb * try_divide(sb, n))"))
    array = F.array(*[F.lit(f) for f in names])
    return sums.select(F.get(array, F.col("i").cast("int")).alias("a"), F.get(array, F.col("j").cast("int")).alias("b"),
                       F.try_divide(F.expr("p - sa * try_divide(sb, n)"), spread).alias("corr"))


def correlated_features(df: DataFrame, features: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Features whose correlation with an earlier one exceeds the threshold."""
    return correlations(df, features).groupBy(F.col("b").alias("feature")).agg(
        F.max(F.abs("corr")).alias("max_abs_corr")).where(F.col("max_abs_corr") > threshold)


def drop_correlated(df: DataFrame, features: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Go through the features in order; drop one that correlates highly with an earlier one that is kept."""
    close = {(r["a"], r["b"]) for r in correlations(df, features).where(F.abs("corr") > threshold).collect()}
    kept: list[str] = []
    for name in features:
        if not any((other, name) in close for other in kept):
            kept.append(name)
    return df.drop(*[f for f in features if f not in kept])


def select_f_regression(df: DataFrame, features: Sequence[str], target: str, k: int = 50) -> DataFrame:
    """Features by the F statistic of a one-variable regression."""
    aggs = []
    for f in features:
        both = F.col(f).isNotNull() & F.col(target).isNotNull()
        aggs.append(F.struct(F.lit(f).alias("feature"), F.corr(f, target).alias("r"), F.count_if(both).alias("n")).alias(f))
    tall = df.agg(*aggs).select(F.inline(F.array(*[F.col(f"`{f}`") for f in features])))
    r2 = F.col("r") * F.col("r")
    return tall.withColumn("f_score", F.try_divide(r2, 1 - r2) * (F.col("n") - 2)).orderBy(
        F.col("f_score").desc_nulls_last(), "feature").limit(k)


def _bin(value: Column, edges: Sequence[Column]) -> Column:
    total = F.lit(0)
    for e in edges:
        total = total + (value > e).cast("int")
    return total


def select_mutual_info(df: DataFrame, features: Sequence[str], target: str, k: int = 50, bins: int = 10) -> DataFrame:
    """Features by mutual information with the target, both cut at their quantiles."""
    probs = [i / bins for i in range(1, bins)]
    tall = df.where(F.col(target).isNotNull()).select(
        F.col(target).alias("__t"), F.inline(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    ).where(F.col("v").isNotNull())
    edges = D.quantiles(tall, ["feature"], "v", probs, "disc")
    target_edges = D.quantiles(df.select(F.col(target).alias("__t")), [], "__t", probs, "disc").select(
        F.struct(*[f"q{i}" for i in range(len(probs))])).scalar()
    cut = tall.join(edges, "feature").withColumn("__e", target_edges).select(
        "feature", _bin(F.col("v"), [F.col(f"q{i}") for i in range(len(probs))]).alias("x"),
        _bin(F.col("__t"), [F.col("__e")[f"q{i}"] for i in range(len(probs))]).alias("y"))
    cells = cut.groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    # At most bins x bins cells per feature: marginal counts are plain windows.
    by = Window.partitionBy
    scored = cells.withColumns({
        "n_all": F.sum("n").over(by("feature")), "n_x": F.sum("n").over(by("feature", "x")),
        "n_y": F.sum("n").over(by("feature", "y"))})
    p = F.col("n") / F.col("n_all")
    term = p * F.ln(F.col("n") * F.col("n_all") / (F.col("n_x") * F.col("n_y")))
    return scored.groupBy("feature").agg(F.sum(term).alias("mutual_info")).orderBy(
        F.col("mutual_info").desc(), "feature").limit(k)


def split_overlap(df: DataFrame, ts: str = "dt") -> DataFrame:
    """Time range of each split and whether it starts after all earlier ones ended."""
    ranges = df.groupBy("split").agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    ends = ranges.agg(F.struct(
        F.max(F.when(F.col("split") == "train", F.col("last"))).alias("train"),
        F.max(F.when(F.col("split") == "val", F.col("last"))).alias("val"))).scalar()
    before = F.when(F.col("split") == "val", F.col("__e.train")).when(
        F.col("split") == "test", F.greatest("__e.train", "__e.val"))
    return ranges.withColumn("__e", ends).withColumn(
        "ordered", F.coalesce(F.col("first") > before, F.lit(True))).drop("__e")


def future_leaks(df: DataFrame, build, names: Sequence[str], cutoff: str, keys: Sequence[str], dt: str = "dt",
                 tolerance: float = 1e-9) -> DataFrame:
    """Per feature: rows before the cutoff whose value changes when later rows are hidden."""
    past = F.col(dt) < F.lit(cutoff).cast("date")
    full = build(df).where(past).select(*keys, *[F.col(n).alias(f"{n}__full") for n in names])
    cut = build(df.where(past)).select(*keys, *names)
    joined = cut.join(full, list(keys))
    parts = []
    for n in names:
        a, b = F.col(n), F.col(f"{n}__full")
        same = a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= F.abs(b) * tolerance, F.lit(False))
        parts.append(F.struct(F.lit(n).alias("feature"), F.count("*").alias("compared"), F.count_if(~same).alias("leaks")).alias(n))
    return joined.agg(*parts).select(F.inline(F.array(*[F.col(n) for n in names])))


def dataset_metadata(samples: DataFrame, features: Sequence[str], lookback: int, horizons: Sequence[int]) -> DataFrame:
    """One row: feature list, shapes and samples per split."""
    return samples.agg(
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")],
        F.count("*").alias("n_samples"),
    ).withColumns({
        "lookback": F.lit(lookback).cast("long"), "n_features": F.lit(len(features)).cast("long"),
        "n_horizons": F.lit(len(horizons)).cast("long"),
        "features": F.array(*[F.lit(f) for f in features]), "horizons": F.array(*[F.lit(h) for h in horizons]),
    })
