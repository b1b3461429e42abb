"""Ordered-series building blocks that never need one task per series.

A plain ``Window.partitionBy(ticker)`` sends a whole series to one task, so a
ticker that holds a third of the data becomes the job. Here a series is cut into
blocks instead:

* ``running`` computes prefix sums, last-known values and running minima. Rows are
  windowed inside fixed time buckets; what earlier buckets contribute is an
  ordinary (map-side combined) aggregate per bucket, folded over the small bucket
  table and joined back.
* ``over_blocks`` evaluates windows that look a bounded number of rows back or
  ahead. It numbers the rows of each series with ``running``, cuts the numbering
  into blocks, and copies only the rows a neighbouring block has to see.

Both give exactly the rows a per-series window would give. Rows must be unique in
their order columns; tables with repeated keys go through ``merge.dedupe`` first,
which is an aggregate and combines copies before any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barline.functions.timeops import step_seconds

BLOCK_ROWS = 65_536
BUCKET = "__bucket"


@dataclass(frozen=True)
class Series:
    """Which columns name a series and which order it.

    ``bucket`` maps a row to a coarse, order-preserving bucket number; it has to
    be a function of the first order column. For bars, whose key is unique per
    timestamp, a bucket of ``block_rows`` periods holds at most ``block_rows`` rows.
    """

    keys: tuple[str, ...] = ("ticker", "frequency")
    order: tuple[str, ...] = ("ts",)
    block_rows: int = BLOCK_ROWS
    bucket: Callable[["Series"], Column] | None = None

    def bucket_column(self) -> Column:
        if self.bucket is not None:
            return self.bucket(self)
        seconds = F.unix_seconds(F.col(self.order[0]).cast("timestamp"))
        width = step_seconds(F.col("frequency")) * F.lit(self.block_rows)
        return F.floor(seconds / width)


def bars(block_rows: int = BLOCK_ROWS) -> Series:
    """Series of (ticker, frequency) ordered by ``ts``, one row per period."""
    return Series(block_rows=block_rows)


def daily(keys: Sequence[str], day: str = "dt", block_rows: int = BLOCK_ROWS) -> Series:
    """Series with at most one row per day."""
    return Series(tuple(keys), (day,), block_rows,
                  lambda s: F.floor(F.unix_date(F.col(day)) / F.lit(s.block_rows)))


def stepped(keys: Sequence[str], step: str, block_rows: int = BLOCK_ROWS) -> Series:
    """Series ordered by an integer step that does not repeat."""
    return Series(tuple(keys), (step,), block_rows,
                  lambda s: F.floor(F.col(step) / F.lit(s.block_rows)))


def timed(keys: Sequence[str], order: Sequence[str], seconds: int = 60) -> Series:
    """Irregular series cut into short, fixed stretches of time.

    However hot a key is, one task gets what arrives for it in ``seconds``; the
    number of buckets of a key is bounded by the calendar.
    """
    return Series(tuple(keys), tuple(order), BLOCK_ROWS,
                  lambda s: F.floor(F.unix_seconds(F.col(order[0]).cast("timestamp")) / F.lit(seconds)))


def running(
    df: DataFrame,
    series: Series,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    before_row: Sequence[str] = (),
) -> DataFrame:
    """Add running values over each series up to and including the row.

    ``sums`` are running totals (0 where nothing was seen), ``lasts`` the latest
    non-null value, ``mins`` the smallest value so far and ``nexts`` the nearest
    non-null value from the row onwards. Names listed in ``before_row`` leave the
    row itself out.

    The input is evaluated twice, once narrow for the bucket totals. Chains of these
    on a derived input should start from a written table (``session.settle``); chains
    on a frame that went through ``bucketed`` share one shuffle and sort of its rows.
    """
    sums, lasts, mins, nexts = dict(sums or {}), dict(lasts or {}), dict(mins or {}), dict(nexts or {})
    keys = list(series.keys)
    every = {**sums, **lasts, **mins, **nexts}
    rows = df.withColumns({f"__in_{n}": e for n, e in every.items()})

    def values(forward: WindowSpec, backward: WindowSpec, prefix: str) -> dict[str, Column]:
        """Running values inside one window, over the inputs or the bucket totals."""
        source = "__in_" if prefix == "__run_" else "__tot_"

        def frame(name: str) -> WindowSpec:
            skip = prefix == "__carry_" or name in before_row
            return forward.rowsBetween(Window.unboundedPreceding, -1 if skip else 0)

        back = backward.rowsBetween(Window.unboundedPreceding, -1 if prefix == "__carry_" else 0)
        return {
            **{prefix + n: F.sum(source + n).over(frame(n)) for n in sums},
            **{prefix + n: F.last(source + n, True).over(frame(n)) for n in lasts},
            **{prefix + n: F.min(source + n).over(frame(n)) for n in mins},
            **{prefix + n: F.last(source + n, True).over(back) for n in nexts},
        }

    ascending, descending = [F.col(c).asc() for c in series.order], [F.col(c).desc() for c in series.order]
    others = [c for c in df.columns if c not in every]
    if BUCKET not in df.columns:
        rows = rows.withColumn(BUCKET, series.bucket_column())
    # A bare column keeps the bucket totals in a hash aggregate.
    position = F.col(series.order[0]) if len(series.order) == 1 else F.struct(*series.order)

    def present(name: str) -> Column:
        return F.when(F.col(f"__in_{name}").isNotNull(), position)

    totals = rows.groupBy(*keys, BUCKET).agg(
        *[F.sum(f"__in_{n}").alias(f"__tot_{n}") for n in sums],
        *[F.max_by(f"__in_{n}", present(n)).alias(f"__tot_{n}") for n in lasts],
        *[F.min(f"__in_{n}").alias(f"__tot_{n}") for n in mins],
        *[F.min_by(f"__in_{n}", present(n)).alias(f"__tot_{n}") for n in nexts])
    over = Window.partitionBy(*keys)
    carry = totals.withColumns(values(over.orderBy(F.col(BUCKET).asc()), over.orderBy(F.col(BUCKET).desc()), "__carry_"))
    carry = carry.select(*keys, BUCKET, *[f"__carry_{n}" for n in every])

    inside = Window.partitionBy(*keys, BUCKET)
    local = rows.withColumns(values(inside.orderBy(*ascending), inside.orderBy(*descending), "__run_"))
    combine = {
        **{n: F.coalesce(f"__run_{n}", F.lit(0)) + F.coalesce(f"__carry_{n}", F.lit(0)) for n in sums},
        **{n: F.coalesce(f"__run_{n}", f"__carry_{n}") for n in [*lasts, *nexts]},
        **{n: F.least(f"__run_{n}", f"__carry_{n}") for n in mins},
    }
    # Missing keys and missing times are values of their own, so the join is null-safe.
    shared = [*keys, BUCKET]
    carry = carry.withColumnsRenamed({k: f"__of_{k}" for k in shared})
    met = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in shared]
    return local.join(carry, met, "left").select(
        *others, *[combine[n].alias(n) for n in every])


def bucketed(df: DataFrame, series: Series) -> DataFrame:
    """Fix the bucket column up front, so that consecutive running passes share it."""
    return df.withColumn(BUCKET, series.bucket_column())


def with_position(df: DataFrame, series: Series, name: str = "pos", **sums: Column) -> DataFrame:
    """Number the rows of every series 1, 2, 3, ... in order; add running ``sums`` too."""
    return running(df, series, sums={name: F.lit(1).cast("long"), **sums})


@dataclass(frozen=True)
class Blocks:
    """The windows available to a step: one block of one series, in row order."""

    keys: tuple[str, ...]

    @property
    def window(self) -> WindowSpec:
        return self.within()

    def within(self, *parts: str) -> WindowSpec:
        """A finer window inside the block; needs no further shuffle."""
        return Window.partitionBy(*self.keys, "__block", *parts).orderBy("pos")


Step = Callable[[DataFrame, Blocks], DataFrame]


def columns(**exprs: Callable[[WindowSpec], Column]) -> Step:
    """A step for ``over_blocks`` that adds one column per expression."""
    return lambda df, blocks: df.withColumns({name: fn(blocks.window) for name, fn in exprs.items()})


def over_blocks(
    df: DataFrame,
    series: Series,
    steps: Sequence[Step],
    before: int = 0,
    after: int = 0,
    numbered: bool = False,
) -> DataFrame:
    """Run window ``steps`` that see ``before`` rows back and ``after`` rows ahead.

    Steps get the rows with their block and the windows over it.
    ``pos`` (the row number inside the series) is available to them and stays in the
    result; with ``numbered`` the input has it already. Rolling frames may not reach
    further than declared.
    """
    rows = df if numbered else with_position(df, series)
    size = F.lit(max(series.block_rows, before, after)).cast("long")
    zero = F.col("pos") - 1
    own = F.floor(zero / size)
    offset = zero - own * size
    homes = [own]
    if before:
        homes.append(F.when(offset >= size - before, own + 1))
    if after:
        homes.append(F.when((offset < after) & (own > 0), own - 1))
    placed = rows.withColumn("__block", F.explode(F.array_compact(F.array(*homes))))
    blocks = Blocks(series.keys)
    for step in steps:
        placed = step(placed, blocks)
    return placed.where(F.floor((F.col("pos") - 1) / size) == F.col("__block")).drop("__block")


def rolling(w: WindowSpec, n: int) -> WindowSpec:
    """The row and the ``n - 1`` rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def full_window(agg: Callable[[str], Column], column: str, w: WindowSpec, n: int) -> Column:
    """``agg`` over ``n`` rows, NULL until the window holds ``n`` non-null values."""
    frame = rolling(w, n)
    return F.when(F.count(column).over(frame) == n, agg(column).over(frame))

