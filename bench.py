"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from lumenfold.plans import registry

HEADLINE = (
    "calendar_select", "event_identity", "score_terms", "tag_type_scale_region", "lane_route", "rank_blend", "series_groups", "series_rep_rank", "global_rank", "ghost_flag", "source_freshness",
    "catalog_version", "catalog_diff", "route_totals", "venue_block_pairs", "group_matrix", "offer_upsert", "best_market_match", "concordance", "affinity_build", "feedback_fold", "stars_last_state",
    "clean_detail", "junk_gate", "names_in_texts", "page_text", "top_picks", "slate_fill", "dedupe_greedy",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", shared).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took = registry.queries(), {}
    known["calendar_select"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles and warms up
    for name in HEADLINE:
        began = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
