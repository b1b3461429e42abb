"""Staged merges, deletes and incremental work lists.

Every function returns the resulting table; ``sources.writers`` persists it by
replacing the touched partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import timeops

KEY = ["ticker", "ts", "frequency"]


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key, the last or first by ``order``.

    An aggregate, not a ranking window: copies of one key are combined before the
    shuffle, however many there are.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    return (df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
            .select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns]))


def _staged(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One staged row per key: the last taken in, else the largest by the other columns."""
    rest = [c for c in source.columns if c not in keys]
    order = ["ingested_at", *rest] if "ingested_at" in rest else rest
    return dedupe(source, keys, order) if rest else source.distinct()


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Matched keys take the source row, new keys are added; repeated staged keys count once."""
    source = _staged(source, keys)
    kept = target.join(source.select(*keys), list(keys), "left_anti")
    return kept.unionByName(source.select(*target.columns))


def merge_coalesce(target: DataFrame, source: DataFrame, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Matched keys take source values where present and keep the old ones elsewhere; repeated staged keys count once."""
    source = _staged(source, keys)
    rest = [c for c in target.columns if c not in keys]
    t, s = target.alias("t"), source.alias("s")
    joined = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full_outer")
    both = {c: F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")) for c in [*keys, *rest]}
    return joined.select(*[both[c].alias(c) for c in target.columns])


def merge_insert_only(target: DataFrame, source: DataFrame, keys: Sequence[str] = tuple(KEY),
                      order: Sequence[str] = ("ingested_at",)) -> DataFrame:
    """Add rows whose key is new; existing rows never change."""
    fresh = dedupe(source, keys, order).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def _same_frequency(name: str) -> Column:
    """Whether the stored spelling means the same period."""
    return timeops.canonical_frequency(F.col("frequency")) == timeops.FREQUENCY_ALIASES.get(name, name)


def in_range(tickers: Sequence[str], start: str | None, end: str | None, frequency: str | None) -> Column:
    test = F.col("ticker").isin(list(tickers))
    if start is not None and end is not None:
        test = test & F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    if frequency is not None:
        test = test & _same_frequency(frequency)
    return test


def delete_where(df: DataFrame, test: Column) -> DataFrame:
    """Rows for which ``test`` is not true (NULL counts as not true)."""
    return df.where(~F.coalesce(test, F.lit(False)))


def delete_key_range(df: DataFrame, tickers: Sequence[str], start: str, end: str, frequency: str) -> DataFrame:
    return delete_where(df, in_range(tickers, start, end, frequency))


def delete_topic_group(df: DataFrame, group: str, frequency: str) -> DataFrame:
    return delete_where(df, (F.col("topic_group_id") == group) & _same_frequency(frequency))


def purge(df: DataFrame, tickers: Sequence[str]) -> DataFrame:
    return delete_where(df, in_range(tickers, None, None, None))


def null_out_columns(df: DataFrame, names: Sequence[str], test: Column) -> DataFrame:
    hit = F.coalesce(test, F.lit(False))
    return df.withColumns({n: F.when(~hit, F.col(n)) for n in names})


def high_water_mark(df: DataFrame, keys: Sequence[str] = ("ticker", "frequency"), ts: str = "ts") -> DataFrame:
    """Latest timestamp per key and the start of the next period."""
    top = df.groupBy(*keys).agg(F.max(ts).alias("last_ts"))
    step = timeops.step_seconds(F.col("frequency")) if "frequency" in keys else F.lit(900).cast("long")
    return top.withColumn("next_start", F.timestamp_seconds(F.unix_seconds("last_ts") + step))


def exists_check(work: DataFrame, df: DataFrame, keys: Sequence[str] = ("ticker", "frequency")) -> DataFrame:
    """The work list with a flag telling whether any row exists for the key."""
    known = canonical_rows(df.select(*keys)).distinct().withColumn("__known", F.lit(True))
    joined = canonical_rows(work.withColumn("__asked", F.struct(*work.columns))).join(known, list(keys), "left")
    return joined.select(*[F.col(f"__asked.{c}").alias(c) for c in work.columns],
                         F.coalesce("__known", F.lit(False)).alias("has_data"))


def canonical_rows(df: DataFrame) -> DataFrame:
    """Frequencies under their canonical names."""
    if "frequency" not in df.columns:
        return df
    return df.withColumn("frequency", timeops.canonical_frequency(F.col("frequency")))


def any_row(df: DataFrame, test: Column) -> bool:
    return not df.where(test).limit(1).isEmpty()


def topup_plan(work: DataFrame, df: DataFrame, start: str, end: str, top_up: bool = True) -> DataFrame:
    """Per requested ticker: load from ``start``, continue after the last row, or skip.

    Top-up is looked at before skipping: a ticker with data continues after its
    last row unless that is past the end of the requested range.
    """
    asked = canonical_rows(work.withColumn("__asked", F.col("frequency")))
    planned = asked.join(high_water_mark(canonical_rows(df)), ["ticker", "frequency"], "left").withColumn("frequency", F.col("__asked"))
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    past = F.col("next_start") > last
    new = F.col("last_ts").isNull()
    action = F.when(new, "load").when(F.lit(not top_up) | past, "skip").otherwise("top_up")
    begin = F.when(new, first).when(F.lit(top_up) & ~past, F.col("next_start"))
    return planned.select("ticker", "frequency", action.alias("action"), begin.alias("start_ts"),
                          F.when(begin.isNotNull(), last).alias("end_ts"))


def registry_upsert(registry: DataFrame, rows: DataFrame) -> DataFrame:
    return merge_upsert(registry, rows, ["version"])


def registry_delete(registry: DataFrame, versions: DataFrame) -> DataFrame:
    return registry.join(versions.select("version"), "version", "left_anti")
