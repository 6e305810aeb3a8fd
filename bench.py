"""Wall time of the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
Each query runs once to warm up and is then timed, with all columns computed and nothing
returned to the driver.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from feedloom.operators.staging import release
from workloads.queries import QUERIES
from workloads.views import SPREAD

HEADLINE = (
    "harvest_digest", "feed_links", "articles", "related_stories", "external_sources",
    "article_text", "extract_page_links", "clean_documents", "entity_counts",
    "parse_dates_absolute_en", "take_until_stale", "feed_stop", "incremental_load",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='feedloom-')}")
        .config(SPREAD, cpus)  # the test tables are files of one row group each
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline queries, second run", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
