"""Time headline queries at one scale and print one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "indicator_core", "indicator_set", "macd", "rsi", "obv", "sentiment_15m", "sentiment_daily", "resample",
    "topic_group_mean", "coverage", "null_coverage", "quality_flags", "date_gaps", "null_islands", "ffill_limit",
    "interpolate", "join_bars_indicators", "asof_backward", "expected_vs_actual", "merge_upsert", "merge_coalesce",
    "delete_by_key_range", "dedupe_keep_last", "describe_bars", "ohlc_bars", "pivot_features", "sequences",
    "scaler_robust", "training_matrix", "per_horizon", "coverage_calibration", "best_step", "early_stop",
    "run_table", "stream_sentiment_15m", "stream_ohlc",
]


def main() -> None:
    from barline import build_session
    from barline.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query, so that the first timed one does not pay for JVM start-up.
    catalog.QUERIES["returns"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
