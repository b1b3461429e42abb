"""Registered queries: filters, projections and scalar functions (F, T, J, X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions import numeric, text, timeops
from barline.operators import filters, indicators as I, joins as J, merge as M, sentiment, warmup
from barline.plans import oracle as O
from barline.plans.registry import query
from barline.sources import fixtures as X

W = "OVER (PARTITION BY ticker ORDER BY dt)"
_ART = "SELECT article_id, v2themes, v2locations, source FROM articles"


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.articles(spark, sf_dir)


def _art(df: DataFrame) -> DataFrame:
    return df.select("article_id", "v2themes", "v2locations", "source")


query("topic_filter", O.with_(O.ARTICLES) + _ART + " WHERE contains(v2themes, 'PURCHASE') OR contains(v2themes, 'SIGNUP')")(
    lambda s, d: _art(filters.topic_filter(_articles(s, d), ["purchase", "signup"])))
# More than 32 topics, most of which no article has; "URCH" and "RRO" are parts of themes.
_LONG = [f"no topic {k}" for k in range(40)] + ["urch", "rro"]
query("topic_filter_long", O.with_(O.ARTICLES) + _ART + " WHERE contains(v2themes, 'URCH') OR contains(v2themes, 'RRO')")(
    lambda s, d: _art(filters.topic_filter(_articles(s, d), _LONG)))
query("location_filter", O.with_(O.ARTICLES) + _ART + " WHERE v2locations LIKE '%#US#%'")(
    lambda s, d: _art(filters.location_filter(_articles(s, d))))
query("valid_tone", O.with_(O.PARSED) + """SELECT article_id, tone, word_count FROM parsed
 WHERE v2tone IS NOT NULL AND length(v2tone) > 0 AND word_count >= 20""")(
    lambda s, d: filters.valid_tone(text.parse_tone(_articles(s, d)), min_words=20).select("article_id", "tone", "word_count"))
query("weekend_filter", O.with_(O.BARS) + "SELECT ticker, dt, close FROM bars WHERE isodow(dt) < 6")(
    lambda s, d: filters.weekend_filter(X.bars(s, d)).select("ticker", "dt", "close"))

BUCKETS = O.PARSED + """, b AS MATERIALIZED (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
   sum(tone * coalesce(word_count, 1)) / nullif(sum(coalesce(word_count, 1)), 0) AS weighted_avg_tone,
   sum(positive * coalesce(word_count, 1)) / nullif(sum(coalesce(word_count, 1)), 0) AS weighted_avg_positive,
   sum(negative * coalesce(word_count, 1)) / nullif(sum(coalesce(word_count, 1)), 0) AS weighted_avg_negative,
   sum(polarity * coalesce(word_count, 1)) / nullif(sum(coalesce(word_count, 1)), 0) AS weighted_avg_polarity,
   count(*) AS num_articles, count(DISTINCT source) AS num_sources,
   CAST(sum(coalesce(word_count, 0)) AS BIGINT) AS total_word_count, min(tone) AS min_tone, max(tone) AS max_tone
  FROM parsed GROUP BY 1)"""

_WIDE = """w AS (SELECT ts, weighted_avg_tone * 1.5 AS weighted_avg_tone,
   weighted_avg_polarity - 0.5 AS weighted_avg_polarity FROM b)"""


@query("range_violation", O.with_(BUCKETS, _WIDE) + """SELECT ts, round(weighted_avg_tone, 6) AS weighted_avg_tone,
   round(weighted_avg_polarity, 6) AS weighted_avg_polarity FROM w
 WHERE abs(weighted_avg_tone) > 10 OR weighted_avg_polarity < 0 ORDER BY abs(weighted_avg_tone) DESC, ts LIMIT 20""")
def range_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentiment.sentiment_15m(text.parse_tone(_articles(spark, sf_dir))).select(
        "ts", (F.col("weighted_avg_tone") * 1.5).alias("weighted_avg_tone"),
        (F.col("weighted_avg_polarity") - 0.5).alias("weighted_avg_polarity"))
    return filters.range_violations(rows, ["ts"]).select(
        "ts", *[F.round(n, 6).alias(n) for n in ("weighted_avg_tone", "weighted_avg_polarity")])


_RAW = f"""f AS (SELECT ticker, dt, {O.guard('avg', 'close', 50)} AS sma_50, {O.guard('avg', 'close', 200)} AS sma_200 FROM bars)"""


def _smas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.indicator_set(X.bars(spark, sf_dir), ["sma_50", "sma_200"])


def _sma_out(df: DataFrame) -> DataFrame:
    return df.select("ticker", "dt", F.round("sma_50", 6).alias("sma_50"), F.round("sma_200", 6).alias("sma_200"))


_SMA_COLS = "SELECT ticker, dt, round(sma_50, 6) AS sma_50, round(sma_200, 6) AS sma_200 FROM f"
query("any_non_null", O.with_(O.BARS, _RAW) + _SMA_COLS + " WHERE coalesce(sma_50, sma_200) IS NOT NULL")(
    lambda s, d: _sma_out(filters.any_non_null(_smas(s, d), ["sma_50", "sma_200"])))
query("drop_all_null", O.with_(O.BARS, _RAW) + _SMA_COLS + " WHERE NOT (sma_50 IS NULL AND sma_200 IS NULL)")(
    lambda s, d: _sma_out(filters.drop_all_null(_smas(s, d), ["sma_50", "sma_200"])))


@query("column_select_by_group", O.with_(O.BARS) + f"""SELECT ticker, dt, round(close / lag(close, 1) {W} - 1, 6) AS returns,
 round(close / lag(close, 5) {W} - 1, 6) AS returns_5, round(ln(close / lag(close, 1) {W}), 6) AS log_returns,
 round({O.guard('avg', 'close', 10)}, 6) AS sma_10, round({O.guard('avg', 'close', 20)}, 6) AS sma_20,
 round({O.guard('avg', 'close', 50)}, 6) AS sma_50, round({O.guard('avg', 'close', 200)}, 6) AS sma_200 FROM bars""")
def column_select_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = I.groups_to_columns(["returns", "sma"])
    return I.indicator_set(X.bars(spark, sf_dir), names).select("ticker", "dt", *[F.round(n, 6).alias(n) for n in names])


@query("nan_inf_to_null", O.with_(O.BARS) + """SELECT ticker, dt,
 CASE WHEN transactions = 1 OR volume > 200 THEN NULL ELSE close END AS close FROM bars""")
def nan_inf_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.when(F.col("transactions") == 1, F.lit(float("nan"))).when(
        F.col("volume") > 200, F.lit(float("inf"))).otherwise(F.col("close"))
    return numeric.finite_columns(X.bars(spark, sf_dir).withColumn("close", dirty), ["close"]).select("ticker", "dt", "close")


@query("warmup_cut", O.with_(O.NUMBERED) + """SELECT s.ticker, s.dt, s.close FROM s
 JOIN (SELECT ticker, min(dt) AS start_dt FROM s WHERE rn >= 50 GROUP BY ticker) p ON p.ticker = s.ticker AND s.dt >= p.start_dt""")
def warmup_cut_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = X.bars(spark, sf_dir)
    return filters.warmup_cut(bars, warmup.warmup_starts(bars, 50), ["ticker", "frequency"]).select("ticker", "dt", "close")


@query("name_prefix_select", O.with_(O.BARS) + f"""SELECT ticker, dt, round({O.guard('avg', 'close', 10)}, 6) AS sma_10,
 round({O.guard('avg', 'close', 20)}, 6) AS sma_20 FROM bars""")
def name_prefix_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = I.indicator_set(X.bars(spark, sf_dir), ["returns", "sma_10", "sma_20", "volume_ma_5"])
    kept = filters.select_prefixes(wide, ["ticker", "dt"], ["sma_"])
    return kept.select("ticker", "dt", *[F.round(c, 6).alias(c) for c in kept.columns if c.startswith("sma_")])


@query("align_range", O.with_(O.BARS, O.SPARSE) + """, r AS (SELECT
   greatest((SELECT min(dt) FROM bars), (SELECT min(dt) FROM sparse_bars)) AS lo,
   least((SELECT max(dt) FROM bars), (SELECT max(dt) FROM sparse_bars)) AS hi)
 SELECT 'bars' AS side, ticker, dt FROM bars, r WHERE dt BETWEEN lo AND hi
 UNION ALL SELECT 'sparse', ticker, dt FROM sparse_bars, r WHERE dt BETWEEN lo AND hi""")
def align_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = filters.align_range([X.bars(spark, sf_dir), X.sparse_bars(spark, sf_dir)])
    return a.select(F.lit("bars").alias("side"), "ticker", "dt").unionByName(
        b.select(F.lit("sparse").alias("side"), "ticker", "dt"))


# --- time, text and numeric functions ---------------------------------------

query("bucket_15m", O.with_(O.ARTICLES) + """SELECT article_id, date_trunc('hour', ts)
   + to_minutes(CAST(minute(ts) // 15 * 15 AS INTEGER)) AS bucket FROM articles""")(
    lambda s, d: _articles(s, d).select("article_id", timeops.bucket_15m(F.col("ts")).alias("bucket")))
query("parse_compact_ts", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")(
    lambda s, d: X.table(s, d, "events").select(
        "event_id", timeops.parse_compact(F.date_format("ts", "yyyyMMddHHmmss").cast("long")).alias("ts")))
query("resample_label", O.with_(O.ARTICLES) + """SELECT article_id, time_bucket(INTERVAL 1 HOUR, ts) AS label_1h,
   time_bucket(INTERVAL 4 HOUR, ts) AS label_4h, date_trunc('day', ts) AS label_1d,
   CAST(CAST(ts AS DATE) + CAST(mod(7 - isodow(ts), 7) AS INTEGER) AS TIMESTAMP) AS label_1w FROM articles""")(
    lambda s, d: _articles(s, d).select("article_id", *[
        timeops.resample_label(F.col("ts"), f).alias(f"label_{f}") for f in ("1h", "4h", "1d", "1w")]))
_CAL = """SELECT article_id, ts, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, day(ts) AS day_of_month, month(ts) AS month,
   CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM articles"""
query("calendar_features", O.with_(O.ARTICLES) + f"""SELECT article_id, CAST(hour AS BIGINT) AS hour, CAST(day_of_week AS BIGINT) AS day_of_week,
   CAST(day_of_month AS BIGINT) AS day_of_month, CAST(month AS BIGINT) AS month, CAST(is_weekend AS BIGINT) AS is_weekend FROM ({_CAL})""")(
    lambda s, d: timeops.calendar_features(_articles(s, d)).select(
        "article_id", "hour", "day_of_week", "day_of_month", "month", "is_weekend"))
_CYC = [f"{n}_{f}" for n in ("hour", "day", "month") for f in ("sin", "cos")]
query("cyclical_encode", O.with_(O.ARTICLES) + "SELECT article_id, " + ", ".join(
    f"round({f}(2 * pi() * {c} / {k}), 8) + 0.0 AS {n}_{f}" for n, c, k in
    (("hour", "hour", 24.0), ("day", "day_of_week", 7.0), ("month", "month", 12.0)) for f in ("sin", "cos")) + f" FROM ({_CAL})")(
    lambda s, d: timeops.cyclical_encode(timeops.calendar_features(_articles(s, d))).select(
        "article_id", *[F.round(n, 8).alias(n) for n in _CYC]))


@query("warmup_plan", O.with_(O.NUMBERED) + """SELECT ticker, 'daily' AS frequency,
   coalesce(max(CASE WHEN before = 200 THEN dt END), min(dt)) AS fetch_start,
   min(CASE WHEN rn >= 200 AND dt >= DATE '1997-01-01' THEN dt END) AS indicator_value_start,
   max(CASE WHEN dt < DATE '1997-01-01' THEN rn ELSE 0 END) AS warmup_rows
 FROM (SELECT ticker, dt, rn, CASE WHEN dt < DATE '1997-01-01' THEN
   row_number() OVER (PARTITION BY ticker, dt < DATE '1997-01-01' ORDER BY dt DESC) END AS before FROM s)
 GROUP BY ticker""")
def warmup_plan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = warmup.warmup_plan(X.bars(spark, sf_dir), "1997-01-01", 200)
    return plan.select("ticker", "frequency", "fetch_start", "indicator_value_start", "warmup_rows")


@query("calendar_spine", O.with_(O.SPARSE) + """SELECT ticker, unnest(generate_series(CAST(min(dt) AS TIMESTAMP),
   CAST(max(dt) AS TIMESTAMP), INTERVAL 1 DAY)) AS ts FROM sparse_bars GROUP BY ticker""")
def calendar_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.calendar(X.sparse_bars(spark, sf_dir), ["ticker"], "daily")


query("parse_tone", O.with_(O.PARSED) + "SELECT article_id, tone, positive, negative, polarity, word_count FROM parsed")(
    lambda s, d: text.parse_tone(_articles(s, d)).select(
        "article_id", "tone", "positive", "negative", "polarity", "word_count"))
query("theme_match", """SELECT event_id, upper(replace(concat(event_type, ' topic'), ' ', '_')) AS theme FROM events""")(
    lambda s, d: X.table(s, d, "events").select(
        "event_id", text.upper_snake(F.concat("event_type", F.lit(" topic"))).alias("theme")))


@query("run_name_encode", """SELECT event_id, concat('reg_md', CASE mod(user_id, 4) WHEN 0 THEN '0' WHEN 1 THEN '0.1' WHEN 2 THEN '0.2' ELSE '0.3' END,
   '_wd', CASE mod(user_id, 2) WHEN 0 THEN '0.07' ELSE '0.5' END, '_gc', CAST(mod(user_id, 30) AS VARCHAR)) AS name FROM events""")
def run_name_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    params = {"md": (u % 4) / 10, "wd": F.when(u % 2 == 0, 0.07).otherwise(0.5), "gc": u % 30}
    return X.table(spark, sf_dir, "events").select("event_id", text.run_name("reg", params).alias("name"))


_TOKENS = ["md", "wd", "gc", "fd", "lr"]


@query("run_name_parse", O.with_(O.SCALARS) + """SELECT DISTINCT run, """ + ", ".join(
    f"TRY_CAST(nullif(regexp_extract(run, '_{t}([0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE) AS {t}" for t in _TOKENS) + " FROM run_scalars")
def run_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = X.run_scalars(spark, sf_dir).select("run").distinct()
    return names.withColumns(text.run_params(F.col("run"), _TOKENS))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two log lines per validation step, numbered per run."""
    rows = X.run_scalars(spark, sf_dir).where(F.col("tag") == "Loss/val")
    lines = F.posexplode(F.array(
        F.concat(F.lit("Epoch "), F.col("step").cast("string"), F.lit("/100")),
        F.concat(F.lit("Val   Loss: "), F.col("value").cast("string"), F.lit(", MAE: 0.1, RMSE: 0.2"))))
    return rows.select("run", "step", lines.alias("part", "line")).select(
        "run", (F.col("step") * 2 + F.col("part")).alias("line_no"), "line")


@query("log_parse", O.with_(O.SCALARS) + """SELECT run, step AS epoch, value AS val_loss FROM run_scalars WHERE tag = 'Loss/val'""")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.parse_log(log_lines(spark, sf_dir))


@query("tag_parse", O.with_(O.SCALARS) + """SELECT DISTINCT tag,
   TRY_CAST(nullif(regexp_extract(split_part(tag, '/', -1), '^H([0-9]+)_', 1), '') AS BIGINT) AS horizon,
   regexp_replace(split_part(tag, '/', -1), '^H[0-9]+_', '') AS metric FROM run_scalars""")
def tag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.run_scalars(spark, sf_dir).select("tag").distinct().withColumns(text.parse_tag(F.col("tag")))


@query("log1p_counts", O.with_(BUCKETS) + """SELECT ts, round(ln(1.0 + num_articles), 8) AS num_articles,
   round(ln(1.0 + num_sources), 8) AS num_sources FROM b""")
def log1p_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentiment.sentiment_15m(text.parse_tone(_articles(spark, sf_dir)))
    names = ["num_articles", "num_sources"]
    return numeric.log1p_columns(rows, names).select("ts", *[F.round(n, 8).alias(n) for n in names])


query("null_safe_ratio", "SELECT event_id, round(user_id / nullif(floor(value), 0), 8) AS ratio FROM events")(
    lambda s, d: X.table(s, d, "events").select(
        "event_id", F.round(numeric.ratio(F.col("user_id"), F.floor("value")), 8).alias("ratio")))


def two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed and stored indicators side by side; stored ones drift after 2000."""
    names = ["sma_10", "sma_20"]
    computed = I.indicator_set(X.bars(spark, sf_dir).select("ticker", "ts", "dt", "frequency", "close"), names)
    drift = F.when(F.col("dt") >= F.lit("2000-01-01").cast("date"), 1.02).otherwise(1.001)
    stored = computed.withColumns({n: F.col(n) * drift for n in names})
    return J.compare_versions(computed, stored, M.KEY + ["dt"], names)


VERSIONS = f"""v AS (SELECT ticker, ts, frequency, dt, {O.guard('avg', 'close', 10)} AS sma_10_computed, {O.guard('avg', 'close', 20)} AS sma_20_computed,
  CASE WHEN dt >= DATE '2000-01-01' THEN 1.02::DOUBLE ELSE 1.001::DOUBLE END AS drift FROM bars),
 pair AS (SELECT *, sma_10_computed * drift AS sma_10_stored, sma_20_computed * drift AS sma_20_stored FROM v)"""
_DIFF = """SELECT '{n}' AS indicator, count({n}_computed) AS compared,
   CAST(sum(CASE WHEN abs({n}_computed - {n}_stored) / abs({n}_stored) > 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS beyond,
   round(100.0 * sum(CASE WHEN abs({n}_computed - {n}_stored) / abs({n}_stored) > 0.01 THEN 1 ELSE 0 END) / count({n}_computed), 6) AS beyond_pct,
   round(max(abs({n}_computed - {n}_stored)), 4) AS max_abs, round(max(abs({n}_computed - {n}_stored) / abs({n}_stored)), 8) AS max_rel FROM pair"""


@query("relative_diff", O.with_(O.BARS, VERSIONS) + " UNION ALL ".join(_DIFF.format(n=n) for n in ("sma_10", "sma_20")))
def relative_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = numeric.compare_summary(two_versions(spark, sf_dir), [
        (n, f"{n}_computed", f"{n}_stored") for n in ("sma_10", "sma_20")], 0.01)
    return out.select("indicator", "compared", "beyond", F.round("beyond_pct", 6).alias("beyond_pct"),
                      F.round("max_abs", 4).alias("max_abs"), F.round("max_rel", 8).alias("max_rel"))
