"""Packed strings, run names, log lines and metric tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators import series as S

# Field positions inside the packed tone string.
TONE_FIELDS = {"tone": 0, "positive": 1, "negative": 2, "polarity": 3}
WORD_COUNT_FIELD = 6


def parse_tone(df: DataFrame, packed: str = "v2tone") -> DataFrame:
    """Unpack the comma separated tone string; missing or malformed fields are NULL."""
    parts = F.split(F.col(packed), ",")
    fields = {name: F.get(parts, F.lit(i)).try_cast("double") for name, i in TONE_FIELDS.items()}
    fields = {name: F.when(~F.isnan(c), c) for name, c in fields.items()}
    return df.withColumns({**fields, "word_count": F.get(parts, F.lit(WORD_COUNT_FIELD)).try_cast("long")})


def upper_snake(topic: Column) -> Column:
    """Topic name in the form themes are stored in."""
    return F.upper(F.replace(topic, F.lit(" "), F.lit("_")))


def vendor_symbol(symbol: Column) -> Column:
    """``BASE-USD`` pairs become ``X:BASEUSD``; other symbols pass through."""
    return F.when(symbol.rlike("^[^-]+-USD$"),
                  F.concat(F.lit("X:"), F.regexp_replace(symbol, "-USD$", "USD"))).otherwise(symbol)


def number_text(value: Column) -> Column:
    """Shortest decimal text that reads back as the same value; with an exponent where decimals do not reach."""
    exact = value.cast("double")
    plain = F.regexp_replace(exact.try_cast("decimal(38,18)").cast("string"), "\\.?0+$", "")
    return F.when(plain.try_cast("double") == exact, plain).otherwise(F.lower(exact.cast("string")))


def run_name(prefix: str, params: Mapping[str, Column]) -> Column:
    """Encode parameters as ``prefix_ab0.1_cd2``."""
    return F.concat_ws("_", F.lit(prefix), *[F.concat(F.lit(k), number_text(v)) for k, v in params.items()])


def run_params(name: Column, tokens: Sequence[str]) -> dict[str, Column]:
    """Named doubles read from a run name's tokens; NULL when a token is absent."""
    return {t: F.regexp_extract(name, f"_{t}([+-]?[0-9]+(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?=_|$)", 1).try_cast("double") for t in tokens}


def parse_tag(tag: Column) -> dict[str, Column]:
    """Horizon (7 in ``.../H7_MAE``, else NULL) and metric name of a scalar tag."""
    leaf = F.element_at(F.split(tag, "/"), -1)
    return {"horizon": F.regexp_extract(leaf, "^H([0-9]+)_", 1).try_cast("long"),
            "metric": F.regexp_replace(leaf, "^H[0-9]+_", "")}


def parse_log(lines: DataFrame, keys: Sequence[str] = ("run",), line_no: str = "line_no", text: str = "line") -> DataFrame:
    """Training log lines to (keys, epoch, val_loss): each loss takes the last epoch seen."""
    epoch = F.regexp_extract(text, "Epoch\\s+([0-9]+)", 1).try_cast("long")
    loss = F.regexp_extract(text, "Val\\s+Loss:\\s*([0-9.eE+-]+|nan)", 1).try_cast("double")
    read = lines.withColumns({"__epoch": epoch, "val_loss": F.when(~F.isnan(loss), loss)})
    marked = S.running(read, S.stepped(keys, line_no), lasts={"epoch": F.col("__epoch")})
    return marked.where(F.col("val_loss").isNotNull() & F.col("epoch").isNotNull()).select(*keys, "epoch", "val_loss")


def best_log_epoch(parsed: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Smallest validation loss per log and the first epoch reaching it."""
    return parsed.groupBy(*keys).agg(
        F.min("val_loss").alias("best_val_loss"),
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"))
