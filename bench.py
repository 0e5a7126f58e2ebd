"""Headline queries, timed one by one. Prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. A query is
built and run to the end without bringing rows to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from altloom.plans import QUERIES
from altloom.session import local_session

HEADLINE = [
    "decision_summary_c18",
    "decision_c18",
    "normalize_universal_b03",
    "truncate_sentence_b01",
    "post_process_u03",
    "is_educational_c11",
    "match_keys_d05",
    "similar_pairs_d12",
    "nearby_text_d14",
    "overlays_d15",
    "retry_gate_d16",
    "telemetry_e02",
    "batch_coverage_e04",
    "slide_text_e21",
    "best_candidate_f05",
    "running_usage_f08",
    "rollup_groups_i02",
    "patch_l01",
    "deck_elements_a02",
    "generate_chain_u02",
]


def run(name: str, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    for name in ("usage_e12", "end_mark_b02"):  # start the JVM's paths before timing
        run(name, spark, sf_dir)
    times = {name: run(name, spark, sf_dir) for name in (sys.argv[1:] or HEADLINE)}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
