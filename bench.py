"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from narrata.plans.registry import QUERIES

#: The thirteen operations that a reader's service does most, and the heaviest of scanning and evaluation.
HEADLINES = {
    "library": "x3_library", "book": "x26_snapshot_ranges", "catalogue": "x2_processed_chapters", "content": "f4_content_seek", "annotations": "a9_projection_counts",
    "review_counts": "a1_review_summary", "review_queue": "x8_review_page", "characters": "a2_appearance_statistics", "roster": "d25_roster_candidates", "job_poll": "a7_job_detail",
    "usage": "a3_usage_summary", "estimate": "d53_estimate", "export_render": "k1_html_pages", "scan": "t1_quotes", "sentences": "t11_sentences", "evaluation": "d41_accepted_accuracy",
}


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a5_runs_by_state"](spark, sf).collect()  # starts what all queries share
    took = {}
    for slot, name in HEADLINES.items():
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[f"{slot}: {name}"] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
