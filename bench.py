"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs once to warm up and then three times; the median counts. Results go to the
``noop`` sink, so all rows are produced but none is stored, unless the query itself writes.
"""

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from catalogue import QUERIES  # noqa: E402
from quadweave.sinks.text import write_rdf  # noqa: E402
from quadweave.sources.files import scratch_folder  # noqa: E402

HEADLINES = [
    "star_schema_map",
    "customer_full_map",
    "template_iri_map",
    "iri_safe_template",
    "natural_types_map",
    "multivalue_map",
    "json_iterator_map",
    "parent_join",
    "parent_join_large",
    "parent_join_semi",
    "parent_join_multi",
    "distinct_statements",
    "count_distinct",
    "nquads_lines",
    "subject_blocks",
    "nq_roundtrip",
    "rj_roundtrip",
    "turtle_load",
    "stream_nquads",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quadweave-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quadweave-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or [*HEADLINES, "star_schema_nquads"]

    def run(name):
        if name == "star_schema_nquads":
            write_rdf(QUERIES["star_schema_map"](spark, folder), scratch_folder(spark, "bench"), "nq")
        else:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in wanted:
        run(name)
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            run(name)
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    statements = QUERIES["star_schema_map"](spark, folder).count() if "star_schema_map" in seconds else None
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rsplit("sf", 1)[-1].strip("/"),
    }
    if statements:
        result["statements_per_second"] = {
            name: round(statements / seconds[name])
            for name in ("star_schema_map", "star_schema_nquads")
            if name in seconds
        }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
