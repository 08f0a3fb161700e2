"""Times headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the threads. The first query of a corpus
includes assigning its positions (timed apart, as ``ingest``); then each query runs once
untimed at the smallest scale for compilation, and once timed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from strideq import queries as Q  # noqa: E402

HEADLINE = [
    "fb_pos", "fb_time", "pb_time", "fb_keyed", "pb_keyed", "fb_neq", "chain3", "chain3_span", "chain_mixed", "nfb", "nfb_keyed",
    "cooccur2", "cooccur3", "quant2", "run_time", "run_pos", "run_link", "sub_fb", "sub_nfb", "bool_and_or_not", "agg_count", "agg_sum",
    "group_day", "order_limit", "tokens", "phrase", "stem", "similar",
]


def main() -> None:
    """Run and print."""
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    began = time.perf_counter()
    for engine in (Q._events_engine, Q._documents_engine, Q._vectors_engine):
        engine(spark, sf)
    took = {"ingest": round(time.perf_counter() - began, 3)}
    small = str(Path(sf).parent / "sf0.001")
    for name in HEADLINE:
        if os.path.isdir(small):
            Q.QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        Q.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf).name}))
    spark.stop()


if __name__ == "__main__":
    main()
