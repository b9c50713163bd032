"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs from the Parquet tables to a fully computed result. A first run of the flagship on the same tables
warms the JVM; its time is reported as ``warm_up`` and is not part of the total.
"""

from __future__ import annotations

import json
import os
import re
import time

from starcast.checks.queries import QUERIES
from starcast.session import intermediates, local_session

HEADLINE = [
    "item_cf_predictions",
    "item_similarity",
    "evaluate_item_cf",
    "latest_rating",
    "mutual_friend_means",
    "attach_with_defaults",
    "assemble_pair_features",
    "cold_start",
    "signed_error_totals",
    "linear_recommender",
    "gbt_a_model",
    "hybrid_recommender",
]


def run(spark, name: str, sf_dir: str) -> float:
    with intermediates(spark):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8"})
    warm_up = run(spark, HEADLINE[0], sf_dir)
    seconds = {name: run(spark, name, sf_dir) for name in HEADLINE}
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "rating_prediction_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "warm_up": warm_up,
        "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
