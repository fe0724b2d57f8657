"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SF_DIR, CPUS, RUNS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "5"))
#: A query is run again as long as its runs took less than this many seconds together.
SPEND = 30
#: The workloads of the baseline, by query.
HEADLINE = (
    "bars_ohlcv", "bars_daily", "momentum_strategy", "roll_mean", "roll_quantile", "roll_pct_rank", "ewm_mean", "factor_param_price", "factor_ultra", "factor_cross", "backtest_metrics", "direction_choice",
    "qcut_summary", "value_corr_pairs", "position_rules", "portfolio_returns",
)


def batch_150(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 factors without recursion over 30-minute bars, one plan."""
    from barloom.plans import catalog
    from barloom.plans.factors import long
    from barloom.sources import bars as B

    some = [f for _, _, f, _ in catalog.catalog() if f.source in ("parametric", "ultra") and f.window == 21 and "ewm" not in f.name and "rank" not in f.name][:150]
    bars = B.with_returns(B.bars_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), 30))
    return long(bars, some).groupBy("factor").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"
    from barloom.queries import QUERIES
    from barloom.session import make_session

    spark = make_session("bench", f"local[{CPUS}]", spark_sql_shuffle_partitions=CPUS, spark_driver_memory="12g", spark_ui_enabled="false", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    work = {name: QUERIES[name] for name in HEADLINE} | {"factor_batch_150": batch_150}
    QUERIES["bars_ohlcv"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # warm-up
    for name, run in work.items():
        took = []
        while len(took) < RUNS and (not took or sum(took) < SPEND):
            began = time.perf_counter()
            run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
            spark.catalog.clearCache()
        seconds[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "sum of median seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").rpartition("sf")[2], "cpus": CPUS, "runs": RUNS}))
    spark.stop()


if __name__ == "__main__":
    main()
