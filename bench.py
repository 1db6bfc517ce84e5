"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the data, BENCH_CPUS (default 8) the cores. One small run warms the
session up, then every query is timed once; BENCH_QUERIES names others, separated by commas.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "flagship_entities", "claim_truth_score", "claim_exact_dedup", "claim_promotion_prefix", "claims_as_of_valid", "authority_lookup",
    "conflict_detect_within", "claim_diff", "content_hash_dedup", "boilerplate_strip", "section_diff", "chunk_pack", "parse_quality_score",
    "topic_keyword", "semantic_best_match", "search_bm25", "causal_chain", "event_routing", "plan_full", "commit_batches",
]


def main() -> None:
    from attesta import build_session
    from attesta.queries import load

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "attesta-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, _ = load()
    seconds: dict[str, float] = {}
    known["flagship_entities"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
