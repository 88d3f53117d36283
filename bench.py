"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "component_diff", "component_diff_summary", "param_diff", "net_set_diff", "rename_detect", "file_category", "status_report", "commit_log_paths", "commit_files_summary", "refs_annotated",
    "ancestor_closure", "revision_line_diff", "format_detect", "blob_dedup_rename", "polygon_area", "bbox_union", "layer_xor", "origin_attribution", "wire_ghosts", "layer_styles", "hier_flatten", "svg_points", "wave_compare",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(max(8, 2 * int(cpus)))).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quillon.plans import catalogue

    queries = catalogue.queries()
    queries["component_diff"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not a query's time
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
