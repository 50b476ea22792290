"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driver_queries.catalog import QUERIES  # noqa: E402
from longspan.session import local_session  # noqa: E402

HEADLINE = (
    "progression_outcomes",
    "visit_file_visits",
    "visit_file_measurements",
    "two_file_visits",
    "baseline_wide",
    "missingness_indicators",
    "non_monotonic_visits",
    "role_assignment",
    "standardized_validation",
    "batch_diagnostics",
    "mri_features",
    "kaplan_meier_by_cohort",
    "person_period",
    "concordance_index",
    "ipcw_auc",
    "batch_risk",
    "binary_metrics",
    "quantile_bins",
    "delong_components",
    "bootstrap_comparison",
    "top_drivers",
    "random_effects",
    "interpolated_series",
    "nearest_vectors",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One scan warms the JVM so that the first query is not charged for start-up.
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
