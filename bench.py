"""Wall time of the headline queries: the median of the warm runs of each, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
#: Corpus ingestion, hybrid search and metrics, table analytics, answer screening, event logs.
HEADLINE = ["chunk_documents", "boilerplate_lines", "hybrid_search", "bm25_topk", "knn_exact", "retrieval_metrics", "multi_aggregate", "describe_orders", "group_three_keys", "verdicts", "screen_outputs", "fold_requests", "rate_limit_users", "media_segments"]
WARM = 3


def main() -> None:
    sys.path.insert(0, str(HERE))
    os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lodestrata.plans.registry import QUERIES

    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(WARM + 1):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    scale = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale) if scale.replace(".", "").isdigit() else scale, "cpus": int(cpus), "partitions": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
