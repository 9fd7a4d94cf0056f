"""Time every query once: prints one JSON line with the total and the seconds per query.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores and
BENCH_ONLY, if set, the queries to run (comma-separated). Queries that show another result of a job
that is timed already are left out unless they are named.
"""

import json
import os
import re
import time

from verdictflow.catalog import QUERIES
from verdictflow.session import build_session

SAME_JOB = {
    "new_posts_by_index",
    "score_stored_model",
    "logistic_scores",
    "subword_merges",
    "stream_score_stored",
    "predict_cycle_python",
    "outbox_messages",
    "assess_state",
    "outbox_updates",
    "state_or_empty",
    "history_snapshot",
    "history_keep_day",
    "report_confusion",
    "report_distribution",
    "report_dates",
}


def main():
    data_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [name for name in os.environ.get("BENCH_ONLY", "").split(",") if name]
    spark = build_session(
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{data_dir}/documents.parquet").count()
    seconds = {}
    for name in only or [name for name in QUERIES if name not in SAME_JOB]:
        start = time.perf_counter()
        QUERIES[name](spark, data_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", data_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale[1]) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
