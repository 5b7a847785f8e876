"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. ``python bench.py name ...`` times only those queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from postsift.plans import catalog
from postsift.session import local_session

HEADLINE = [
    "flow_daily_funnel", "d7_near_description_pairs", "d6_near_title_pairs", "d8_filter_new", "d2_dedup_cross_source",
    "d9_upsert_seen", "c4_match_outcomes", "r5_scan_terms", "r5_scan_terms_long_list", "r1_redact", "r2_scan_secrets",
    "q8_top_keywords", "q10_run_checks", "s3_map_alias", "s11_page_text", "n1_normalize_text", "n8_shingles",
    "g4_guard", "p7_recurring_gaps", "v3_parse_verdict", "a2_status_counts", "a8_roundup", "w2_reply_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    timings = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 3)
    print(json.dumps({
        "metric": "headline_query_seconds_total", "value": total, "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
