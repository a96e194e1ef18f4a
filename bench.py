"""Times the headline plans and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.plans import catalogue  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = (
    "daily_bars", "ohlcv_features", "feature_vector", "ewma_normalised", "as_of_lookup", "lagged_history",
    "analog_watchlist", "analog_disagreement", "track_record", "walk_forward", "combinatorial_sharpes",
    "deflated_sharpe", "conditional_expectancy", "contradictions", "fdr_corrected", "tail_aware_kelly",
    "friction_scores", "friction_proxy", "stress_gauge", "two_regime_covariance", "scenario_stress",
    "position_impact", "correlation_clusters", "factor_regressions", "bootstrap_forecast", "fill_costs",
    "sliced_costs", "data_health", "watchlists", "decision_changes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans = catalogue()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        plans[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_plans_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
