"""Registered queries: forecast evaluation and run comparison (E, G6-G7, L6-L8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions import text
from barline.operators import baseline as B
from barline.operators import evaluate as E
from barline.operators import features as Q
from barline.operators import joins as J
from barline.operators import runs as U
from barline.operators import series as S
from barline.plans import feature_queries as FQ
from barline.plans import oracle as O
from barline.plans.filter_queries import log_lines
from barline.plans.registry import query
from barline.session import settle
from barline.sources import fixtures as X

_P = O.with_(O.PREDICTIONS)
_MET = "count(y - yhat) AS n, round(avg(abs(y - yhat)), 6) AS mae, round(avg((y - yhat) ** 2), 6) AS mse, round(sqrt(avg((y - yhat) ** 2)), 6) AS rmse"


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions as a written table, for evaluations that read them repeatedly."""
    return settle(X.predictions(spark, sf_dir), "predictions")


query("mae_rmse", _P + f"SELECT {_MET} FROM predictions")(
    lambda s, d: _round(E.mae_rmse(X.predictions(s, d)), "mae", "mse", "rmse"))
query("per_horizon", _P + f"SELECT CAST(horizon AS INTEGER) AS horizon, {_MET}, concat('H', CAST(horizon AS VARCHAR)) AS label FROM predictions GROUP BY horizon")(
    lambda s, d: _round(E.per_horizon(X.predictions(s, d)), "mae", "mse", "rmse"))
query("dir_acc_sign", _P + "SELECT round(avg(CASE WHEN sign(y) = sign(yhat) THEN 1.0 ELSE 0.0 END) * 100, 6) AS dir_acc FROM predictions")(
    lambda s, d: _round(E.direction_sign(X.predictions(s, d)), "dir_acc"))
query("dir_acc_positive", _P + """SELECT round(avg(CASE WHEN (y > 0) = (yhat > 0) THEN 1.0 ELSE 0.0 END), 6) AS dir_acc FROM predictions
 WHERE horizon = (SELECT min(horizon) FROM predictions)""")(
    lambda s, d: _round(E.direction_positive(_predicted(s, d)), "dir_acc"))
query("dir_acc_diff", _P + """, x AS (SELECT ticker, (y - lag(y) OVER w) * (yhat - lag(yhat) OVER w) AS p FROM predictions
   WHERE horizon = (SELECT min(horizon) FROM predictions) WINDOW w AS (PARTITION BY ticker ORDER BY sample_id))
 SELECT ticker, round(count(*) FILTER (p > 0) / (count(*) - 1), 6) AS dir_acc FROM x GROUP BY ticker""")(
    lambda s, d: _round(E.direction_diff(_predicted(s, d), S.stepped(["ticker"], "sample_id")), "dir_acc"))
query("mape", _P + "SELECT CAST(horizon AS INTEGER) AS horizon, round(avg(abs(y - yhat) / nullif(abs(y), 0)) * 100, 4) AS mape FROM predictions GROUP BY horizon")(
    lambda s, d: _round(E.mape(X.predictions(s, d)), "mape", digits=4))
_QS = [0.1, 0.5, 0.9]
query("quantile_loss", _P + " UNION ALL ".join(
    f"SELECT CAST(horizon AS INTEGER) AS horizon, {q}::DOUBLE AS quantile, round(avg(greatest({q}::DOUBLE * (y - yhat), ({q}::DOUBLE - 1) * (y - yhat))), 6) AS loss FROM predictions GROUP BY horizon"
    for q in _QS))(lambda s, d: _round(E.quantile_loss(X.predictions(s, d), _QS), "loss"))
query("coverage_interval", _P + """SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS n, round(avg(CASE WHEN y BETWEEN yhat - 0.5 AND yhat + 0.5 THEN 1.0 ELSE 0.0 END), 6) AS coverage,
  round(avg((yhat + 0.5) - (yhat - 0.5)), 6) AS width FROM predictions GROUP BY horizon""")(
    lambda s, d: _round(E.interval_coverage(X.predictions(s, d), F.col("yhat") - 0.5, F.col("yhat") + 0.5), "coverage", "width"))
_DEC = [i / 10 for i in range(1, 10)]
query("coverage_calibration", _P + f""", q AS (SELECT horizon, quantile_disc(yhat, {_DEC}) AS e FROM predictions GROUP BY horizon)
 SELECT CAST(p.horizon AS INTEGER) AS horizon, CAST(1 + {' + '.join(f'CAST(yhat > e[{i}] AS INTEGER)' for i in range(1, 10))} AS BIGINT) AS bin,
   count(*) AS n, round(avg(yhat), 6) AS mean_forecast, round(avg(y), 6) AS mean_outcome FROM predictions p JOIN q ON q.horizon = p.horizon GROUP BY 1, 2""")(
    lambda s, d: _round(E.calibration(_predicted(s, d)), "mean_forecast", "mean_outcome"))
query("directional_loss", _P + """SELECT CAST(horizon AS INTEGER) AS horizon, round(avg((y - yhat) ** 2 * CASE WHEN sign(y) <> sign(yhat) THEN 2 ELSE 1 END), 6) AS loss
 FROM predictions GROUP BY horizon""")(lambda s, d: _round(E.directional_loss(X.predictions(s, d)), "loss"))
query("batch_mean_loss", _P + """, e AS (SELECT horizon, (y - yhat) ** 2 AS sq, (row_number() OVER (PARTITION BY horizon ORDER BY dt, ticker) - 1) // 64 AS b FROM predictions),
 g AS (SELECT horizon, b, avg(sq) AS m, sum(sq) AS s, count(sq) AS n FROM e GROUP BY horizon, b)
 SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS batches, round(avg(m), 6) AS batch_mean, round(sum(s) / sum(n), 6) AS exact_mean FROM g GROUP BY horizon""")(
    lambda s, d: _round(E.batch_mean_loss(_predicted(s, d), S.timed(("horizon",), ("dt", "ticker"), 86_400), 64), "batch_mean", "exact_mean"))
query("persistence_forecast", O.with_(O.BARS) + """, h AS (SELECT *, unnest([7, 14]) AS horizon FROM (SELECT ticker, dt, close,
   lead(close, 7) OVER w AS f7, lag(close, 7) OVER w AS l7, lead(close, 14) OVER w AS f14, lag(close, 14) OVER w AS l14 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY dt))),
 y AS (SELECT horizon, CASE horizon WHEN 7 THEN (f7 - close) / close ELSE (f14 - close) / close END AS y,
   CASE horizon WHEN 7 THEN (close - l7) / l7 ELSE (close - l14) / l14 END AS p FROM h),
 z AS (SELECT horizon, 'zero' AS model, y, 0.0::DOUBLE AS yhat FROM y WHERE y IS NOT NULL AND p IS NOT NULL
   UNION ALL SELECT horizon, 'last', y, p FROM y WHERE y IS NOT NULL AND p IS NOT NULL)
 SELECT model, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, round(avg(abs(y - yhat)), 6) AS mae, round(sqrt(avg((y - yhat) ** 2)), 6) AS rmse FROM z GROUP BY model, horizon""")(
    lambda s, d: _round(E.persistence_forecasts(X.bars(s, d), S.bars(), "close", [7, 14]).groupBy("model", "horizon").agg(
        *E.error_metrics()).drop("mse"), "mae", "rmse"))


# --- runs --------------------------------------------------------------------

_S = O.with_(O.SCALARS)
query("best_step", _S + """SELECT run, tag, min(value) AS min_value, arg_min(step, (value, step)) AS min_step, max(value) AS max_value,
   arg_max(step, (value, step)) AS max_step, arg_max(value, step) AS last_value, count(*) AS n FROM run_scalars GROUP BY run, tag""")(
    lambda s, d: U.best_step(X.run_scalars(s, d)))


@query("early_stop", _S + """, v AS (SELECT run, step, value, min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
   FROM run_scalars WHERE tag = 'Loss/val'),
 i AS (SELECT *, max(CASE WHEN best IS NULL OR value < best THEN step END) OVER (PARTITION BY run ORDER BY step) AS hit FROM v),
 s AS (SELECT run, min(CASE WHEN step - hit >= 3 THEN step END) AS stop, max(step) AS fin, count(*) AS n_steps FROM i GROUP BY run)
 SELECT s.run, stop IS NOT NULL AS stopped, coalesce(stop, fin) AS stop_step, i.hit AS best_step, b.value AS best_value, n_steps
 FROM s JOIN i ON i.run = s.run AND i.step = coalesce(stop, fin) JOIN v b ON b.run = s.run AND b.step = i.hit""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = X.run_scalars(spark, sf_dir).where("tag = 'Loss/val'").select("run", "step", "value")
    return U.early_stop(settle(losses, "losses"), 3)


def _pick(tag: str, agg: str) -> str:
    return f"{agg} FILTER (tag = '{tag}')"


_NUMBER = "TRY_CAST(nullif(regexp_extract(run, '_{t}([0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE) AS {t}"
query("run_table", _S + f"""SELECT run, {_pick('Loss/val', 'min(value)')} AS best_loss, {_pick('Loss/val', 'arg_max(value, step)')} AS final_loss,
  {_pick('Metrics/MAE', 'min(value)')} AS best_mae, {_pick('Metrics/MAE', 'arg_max(value, step)')} AS final_mae,
  {', '.join(_NUMBER.format(t=t) for t in ('md', 'wd', 'gc', 'fd'))} FROM run_scalars GROUP BY run""")(
    lambda s, d: U.run_table(X.run_scalars(s, d), {"Loss/val": "loss", "Metrics/MAE": "mae"}, ["md", "wd", "gc", "fd"]))
query("test_metrics", _S + """SELECT run, coalesce(nullif(min(value) FILTER (tag = 'Metrics/RMSE'), 0), nullif(min(value) FILTER (tag = 'Metrics/MAE'), 0),
   nullif(min(value) FILTER (tag = 'Loss/val'), 0)) AS best, arg_max(value, step) FILTER (tag = 'Metrics/DirectionalAccuracy') AS final FROM run_scalars GROUP BY run""")(
    lambda s, d: U.test_metrics(X.run_scalars(s, d), ["Metrics/RMSE", "Metrics/MAE", "Loss/val"], "Metrics/DirectionalAccuracy"))
query("best_trial", _S + """SELECT run, max(value) FILTER (tag = 'Metrics/DirectionalAccuracy') AS best_accuracy, count(*) AS n
 FROM run_scalars GROUP BY run ORDER BY best_accuracy DESC NULLS LAST, run LIMIT 5""")(
    lambda s, d: U.best_trial(X.run_scalars(s, d).groupBy("run").agg(
        F.max(F.when(F.col("tag") == "Metrics/DirectionalAccuracy", F.col("value"))).alias("best_accuracy"),
        F.count("*").alias("n")), "best_accuracy", "run").limit(5))


@query("best_run_all_horizons", _S + """, w AS (SELECT run, min(value) FILTER (tag LIKE '%H7_MAE') AS h7, min(value) FILTER (tag LIKE '%H14_MAE') AS h14 FROM run_scalars GROUP BY run)
 SELECT run, h7, h14, round((h7 + h14) / 2, 6) AS mean_mae FROM w WHERE h7 IS NOT NULL AND h14 IS NOT NULL
   AND NOT EXISTS (SELECT 1 FROM w o WHERE o.h7 < w.h7 AND o.h14 < w.h14)""")
def best_run_all_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, names = U.wide_horizons(U.horizon_table(X.run_scalars(spark, sf_dir)))
    return _round(U.undominated(wide, names), "mean_mae")


_HS = [1, 2, 7, 14, 28]


@query("best_run_five_horizons", O.with_(O.BARS) + ", e AS (" + " UNION ALL ".join(
    f"""SELECT concat(ticker, '_', strftime(dt, '%Y%m')) AS run, {h} AS horizon,
   abs((lead(close, {h}) OVER o - close) / close - (close - lag(close, {h}) OVER o) / lag(close, {h}) OVER o) AS error FROM bars WINDOW o AS (PARTITION BY ticker ORDER BY dt)"""
    for h in _HS) + "), t AS (SELECT run, horizon, round(avg(error), 6) AS mae FROM e WHERE error IS NOT NULL GROUP BY run, horizon), w AS (SELECT run, "
    + ", ".join(f"max(mae) FILTER (horizon = {h}) AS h{h}" for h in _HS) + " FROM t GROUP BY run HAVING count(*) = " + str(len(_HS)) + ") SELECT run, "
    + ", ".join(f"h{h}" for h in _HS) + ", round((" + " + ".join(f"h{h}" for h in _HS) + f") / {len(_HS)}, 6) AS mean_mae FROM w WHERE NOT EXISTS (SELECT 1 FROM w o WHERE "
    + " AND ".join(f"o.h{h} < w.h{h}" for h in _HS) + ")")
def best_run_five_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of a ticker as runs, compared by the errors of persistence forecasts on every horizon."""
    rows = E.persistence_forecasts(X.bars(spark, sf_dir), S.bars(), "close", _HS).where("model = 'last'")
    table = rows.groupBy(F.concat_ws("_", "ticker", F.date_format("ts", "yyyyMM")).alias("run"), "horizon").agg(
        F.round(F.avg(F.abs(F.col("y") - F.col("yhat"))), 6).alias("best_mae"))
    wide, names = U.wide_horizons(settle(table, "errors"))
    return _round(U.undominated(wide, names), "mean_mae")


query("search_summary", _S + """SELECT count(*) AS total, count(*) FILTER (n >= 10) AS succeeded, count(*) FILTER (n < 10) AS failed
 FROM (SELECT run, count(*) FILTER (tag = 'Loss/val') AS n FROM run_scalars GROUP BY run)""")(
    lambda s, d: U.search_summary(X.run_scalars(s, d).groupBy("run").agg(F.count_if(F.col("tag") == "Loss/val").alias("n")), F.col("n") >= 10))


@query("enrich_lr_results", _S + """, r AS (SELECT run, count(*) >= 50 AS success FROM run_scalars GROUP BY run),
 b AS (SELECT run, min(value) AS best_val_loss, arg_min(step, (value, step)) AS best_epoch FROM run_scalars WHERE tag = 'Loss/val' GROUP BY run)
 SELECT r.run, r.success, b.best_val_loss, b.best_epoch FROM r LEFT JOIN b ON b.run = r.run""")
def enrich_lr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = X.run_scalars(spark, sf_dir).groupBy("run").agg((F.count("*") >= 50).alias("success"))
    return U.enrich_results(results, text.parse_log(log_lines(spark, sf_dir)))


# --- yardstick models --------------------------------------------------------

_MODEL_FEATURES = Q.matrix_features(X.BAR_TICKERS, ["close", "volume"])
_WINDOW = 10


@query("baseline_fit_score")
def baseline_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear models on flattened, scaled look-back windows; windows with gaps are left out."""
    rows = FQ.samples(spark, sf_dir)
    scaled = Q.apply_standard(rows, Q.fit_standard(rows, _MODEL_FEATURES, F.col("weight")))
    windows = Q.sequences(scaled, FQ.CALENDAR, _MODEL_FEATURES, "basket_close", _WINDOW, FQ.HORIZONS)
    whole = windows.where(F.forall(F.flatten("x"), lambda v: v.isNotNull()))
    labelled = whole.join(rows.where("split IS NOT NULL").select("dt", "split"), "dt")
    return B.fit_score(settle(B.flatten_windows(labelled, FQ.HORIZONS), "windows"), FQ.HORIZONS)


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FQ.samples(spark, sf_dir).where("split IS NOT NULL")
    return B.assemble(rows.select("split", *[f"target_{h}" for h in FQ.HORIZONS], *_MODEL_FEATURES), _MODEL_FEATURES)


@query("grid_fit")
def grid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.grid_fit(spark, _model_rows(spark, sf_dir), "target_7", B.log_grid(-3, 0, 3), [0.0, 0.5])


@query("tree_fit_score")
def tree_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regression tree per horizon on the rows of the matrix."""
    return B.fit_score(settle(_model_rows(spark, sf_dir), "rows"), FQ.HORIZONS, "tree")


_THERE = " AND ".join(f"{f} IS NOT NULL" for f in _MODEL_FEATURES)
query("scored_rows", FQ._MZ + " UNION ALL ".join(
    f"SELECT split, {h} AS horizon, count(target_{h}) AS n_rows FROM z WHERE split IS NOT NULL AND {_THERE} GROUP BY split" for h in FQ.HORIZONS))(
    lambda s, d: B.scored_rows(_model_rows(s, d), FQ.HORIZONS))


@query("draw_fit")
def draw_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear models with settings drawn at random (see ``hp_draws``), scored on the validation split."""
    rows = settle(_model_rows(spark, sf_dir), "rows")
    drawn = J.parameter_draws(rows.select(F.lit("ridge").alias("model")).distinct(), ["model"], 6, {"reg": (-3, 0)}, {"mix": (0.0, 1.0)})
    return B.draw_fit(rows, "target_7", drawn, "reg", "mix")
