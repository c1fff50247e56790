"""Headline queries, timed once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from arbora.session import local_session  # noqa: E402
from suite import all_queries  # noqa: E402,F401
from suite.registry import QUERIES  # noqa: E402

HEADLINE = (
    "W5_sliding_word_windows",
    "W7_carry_party",
    "C21_adversarial_chunks",
    "C22_hierarchical_chunks",
    "F8_heading_level",
    "F16_party_scores",
    "W1_group_words_into_lines",
    "W3_assemble_paragraphs",
    "C20_normalize_extraction",
    "G1_repeated_furniture_keys",
    "G9_cluster_diagnostics",
    "T8_best_merge_target",
    "C6_build_cluster_plan",
    "C1_cluster_embeddings",
    "C11_summarize",
    "C12_embed",
    "C9_build_structural_tree",
    "T1_match_nodes",
    "T2_match_nodes_batch",
    "T2_match_nodes_batch_owner",
    "T3_retrieve_context",
    "V2_validate_tree",
    "R1_latest_status",
    "S10_register_documents",
    "J13_descendants",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["F22_word_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
