"""Times the headline queries and prints one JSON line; each query's time goes to stderr as soon as it is known.

BENCH_SF_DIR: folder of the tables; BENCH_CPUS: local cores; BENCH_QUERIES: names to run instead;
BENCH_SECONDS: after so many seconds the line is printed with the queries done by then, and those left are named in it.
"""

import json
import os
import sys
import threading
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "rule_metrics_by_period", "p1_fold_label", "p8_parse_number", "p9_parse_bool", "j1_next_period_label", "w5_next_value",
    "j2_pair_metrics", "j3_new_rows", "w2_first_per_key", "w1_row_numbers", "a1_data_status", "a3_numeric_summary",
    "a5_categorical_breakdown", "a10_average_precision_distinct", "a11_roc_auc_overall", "a13_quantile_edges", "a15_psi",
    "a16_numeric_drift", "a17_categorical_drift", "a18_drift_report", "o1_order_panel", "k1_append_new_records",
    "s1_read_layout_csv", "m14_resolve_model", "s4_reference_scan", "m6_logistic_regression", "m7_random_forest",
    "m11_importance_study", "m15_predict", "m9_train_and_select",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from panelwise.catalog import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start the engine
    wanted = os.environ.get("BENCH_QUERIES")
    names, seconds = wanted.split(",") if wanted else HEADLINE, {}

    def report() -> None:
        print(json.dumps({
            "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
            "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0), "not_run": [n for n in names if n not in seconds],
        }), flush=True)

    def stop() -> None:
        report()
        os._exit(0)

    limit = threading.Timer(float(os.environ.get("BENCH_SECONDS", "1500")), stop)
    limit.daemon = True
    limit.start()
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    limit.cancel()
    report()


if __name__ == "__main__":
    main()
