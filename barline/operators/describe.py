"""Exact distributed quantiles and column summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.session import settle

# Sketch accuracy: ranks are off by at most n / ACCURACY.
ACCURACY = 10_000
# Distinct values that are ranked in one task, and bins of a pass that narrows a bracket.
MOST, BINS = 65_536, 4_096


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which missing keys are values of their own."""
    named = right.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys], how).drop(*(f"__of_{k}" for k in keys))


def _targets(brackets: DataFrame, counted: DataFrame, keys: list[str], probs: Sequence[float], method: str) -> DataFrame:
    """One row per key, quantile and rank that it needs: ``__rank``, how many values lie ``__below`` the bracket, the
    values next to the bracket (``__under``, ``__over``) and its ends (``__lo``, ``__hi``)."""
    p, n = F.col("__p"), F.col("__n")
    at = p * (n - 1)
    ranks = [F.floor(at) + 1, F.ceil(at) + 1] if method == "cont" else [F.greatest(F.ceil(F.round(p * n, 9)), F.lit(1))]
    listed = brackets.select(*keys, "__n", F.posexplode(F.array(*[F.lit(float(x)) for x in probs])).alias("__i", "__p")).select(
        *keys, "__i", (at - F.floor(at)).alias("__frac"), F.posexplode(F.array(*ranks)).alias("__which", "__rank"))
    where = lambda zone, c: F.when(F.col("__zone") == zone, F.col(c))
    around = counted.groupBy(*keys, "__i").agg(
        F.coalesce(F.sum(where(-1, "__k")), F.lit(0)).alias("__below"), F.max(where(-1, "__most")).alias("__under"),
        F.min(where(1, "__least")).alias("__over"), F.min(where(0, "__least")).alias("__lo"), F.max(where(0, "__most")).alias("__hi"))
    return _meet(listed, around, [*keys, "__i"])


def _narrow(values: DataFrame, targets: DataFrame, group: list[str], bins: int) -> tuple[DataFrame, DataFrame]:
    """Values and targets after one pass: of each bracket only the bin that holds the target's rank is left."""
    width = F.col("__hi") - F.col("__lo")
    share = F.coalesce(F.try_divide(F.col("__x") - F.col("__lo"), width), F.lit(0.0))
    binned = _meet(values, targets, group).withColumn("__bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
    # At most ``bins`` rows a bracket.
    totals = binned.groupBy(*group, "__rank", "__below", "__bin").agg(
        F.sum("__k").alias("__in"), F.min("__x").alias("__first"), F.max("__x").alias("__last"))
    w = Window.partitionBy(*group).orderBy("__bin")
    totals = totals.withColumns({
        "__before": F.col("__below") + F.coalesce(F.sum("__in").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__left": F.lag("__last", 1).over(w), "__right": F.lead("__first", 1).over(w)})
    inside = (F.col("__rank") > F.col("__before")) & (F.col("__rank") <= F.col("__before") + F.col("__in"))
    # A rank just outside the bracket (the sketch is off by less than one there) stays at its edge.
    hit = settle(totals.where(inside).select(*group, "__bin", F.col("__before").alias("__now"), "__left", "__right",
                                             F.col("__first").alias("__a"), F.col("__last").alias("__z")), "bins")
    chosen = _meet(targets, hit, group, "left")
    missed = F.col("__bin").isNull()
    moved = chosen.select(
        *group, "__frac", "__rank",
        F.when(missed & (F.col("__rank") > F.col("__below")), F.col("__rank") - 1).otherwise(F.coalesce("__now", "__below")).alias("__below"),
        F.when(missed, F.col("__under")).otherwise(F.coalesce("__left", "__under")).alias("__under"),
        F.when(missed, F.col("__over")).otherwise(F.coalesce("__right", "__over")).alias("__over"),
        F.coalesce("__a", "__lo").alias("__lo"), F.coalesce("__z", "__hi").alias("__hi"))
    kept = _meet(binned.select(*group, "__x", "__k", "__bin"), hit.select(*group, "__bin"), [*group, "__bin"]).drop("__bin")
    return settle(kept, "bracket-values"), settle(moved, "brackets")


def select_ranks(values: DataFrame, targets: DataFrame, group: list[str], most: int = MOST, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """Narrow every bracket until it holds at most ``most`` distinct values.

    Each pass counts the values of a bracket in equal bins, combined before the shuffle, and keeps one bin. A bin is
    a ``bins``-th of the range, so a handful of passes exhaust the doubles, whatever their distribution.
    """
    while True:
        largest = values.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= most:
            return values, targets
        values, targets = _narrow(values, targets, group, bins)


def quantiles(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float], method: str = "cont",
              most: int = MOST) -> DataFrame:
    """Exact quantiles per key as columns ``q0``, ``q1``, ...

    Built-in exact percentiles keep all distinct values of a group in one buffer.
    Here a fixed-size sketch brackets each quantile first. Values outside a bracket
    are only counted, the distinct values inside it are narrowed by histograms until
    ``most`` are left, and those are ranked. All groups, large and small, take the
    same way; a rank that is not found is an error, never a missing value. NULLs do
    not count, missing keys are a group.
    ``cont`` interpolates, ``disc`` returns the first value reaching the share.
    """
    keys, given = list(keys) or ["__all"], list(keys)
    margin = 2.0 / ACCURACY
    low = [max(p - margin, 0.0) for p in probs]
    high = [min(p + margin, 1.0) for p in probs]
    rows = df.where(F.col(column).isNotNull()).select(
        *(given or [F.lit(0).alias("__all")]), F.col(column).cast("double").alias("__v"))
    brackets = settle(rows.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        F.percentile_approx("__v", low, ACCURACY).alias("__low"),
        F.percentile_approx("__v", high, ACCURACY).alias("__high")), "sketches")
    v = F.col("__v")

    def mark(i: int) -> Column:
        zone = F.when(v < F.col("__low")[i], -1).when(v > F.col("__high")[i], 1).otherwise(0)
        return F.struct(F.lit(i).alias("i"), zone.alias("zone"), F.when(zone == 0, v).alias("x"))

    joined = _meet(rows, brackets.drop("__n"), keys)
    # Equal values are counted before the shuffle; all that lies on one side of a bracket is one group.
    counted = settle(joined.select(*keys, "__v", F.explode(F.array(*map(mark, range(len(probs))))).alias("__m"))
                     .groupBy(*keys, F.col("__m.i").alias("__i"), F.col("__m.zone").alias("__zone"), F.col("__m.x").alias("__x"))
                     .agg(F.count("*").alias("__k"), F.min("__v").alias("__least"), F.max("__v").alias("__most")), "counted-values")
    group = [*keys, "__i", "__which"]
    targets = settle(_targets(brackets, counted, keys, probs, method), "brackets")
    inside = counted.where("__zone = 0").select(*keys, "__i", "__x", "__k").withColumn(
        "__which", F.explode(F.array(*[F.lit(k) for k in range(2 if method == "cont" else 1)])))
    values, targets = select_ranks(inside, targets, group, most)

    # Long brackets are gone, so that a window holds ``most`` rows.
    up_to = F.sum("__k").over(Window.partitionBy(*group).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = _meet(values.withColumn("__to", up_to), targets.select(*group, "__rank", "__below"), group)
    at = F.col("__rank") - F.col("__below")
    found = ranked.where((at <= F.col("__to")) & (at > F.col("__to") - F.col("__k"))).select(*group, F.col("__x").alias("__value"))
    held = values.groupBy(*group).agg(F.sum("__k").alias("__held"))
    told = _meet(_meet(targets, found, group, "left"), held, group, "left")
    rank, past = F.col("__rank"), F.col("__below") + F.coalesce("__held", F.lit(0))
    value = F.coalesce("__value", F.when(rank == F.col("__below"), F.col("__under")), F.when(rank == past + 1, F.col("__over")),
                       F.raise_error(F.lit(f"a quantile of {column} lies outside its bracket")).cast("double"))
    both = told.groupBy(*keys, "__i").agg(
        F.max(F.when(F.col("__which") == 0, value)).alias("__a"), F.max(F.when(F.col("__which") == 1, value)).alias("__b"), F.max("__frac").alias("__f"))
    one = F.col("__a") if method == "disc" else F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")
    return both.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == i, one)).alias(f"q{i}") for i in range(len(probs))]).select(
        *given, *(f"q{i}" for i in range(len(probs))))


def describe(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Count, mean, deviation, quartiles and extremes per key; flags constant columns."""
    basic = df.groupBy(*keys).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"))
    parts = quantiles(df, keys, column, [0.25, 0.5, 0.75])
    return _meet(basic, parts, list(keys), "left").select(
        *keys, "n", "mean", "std", "min", F.col("q0").alias("q25"), F.col("q1").alias("q50"),
        F.col("q2").alias("q75"), "max", (F.coalesce("std", F.lit(0.0)) < 0.1).alias("constant"))
