"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from scalemetrics.plans import QUERIES  # noqa: E402
from scalemetrics.plans import tables  # noqa: E402
from scalemetrics.workspace import local_session  # noqa: E402

HEADLINE = [
    "p8_percentile_summary", "a1_norms", "p2_unique_origin_counted", "w4_stratified_split", "w5_folds", "w1_exact_quantiles",
    "a12_split_similarity", "a7_item_distribution", "a8_item_domain_corr", "w7_item_ranking", "w10_method_sweep", "w17_multi_pass",
    "a13_accuracy_by_domain", "a14_overall_metrics", "a17_quintile_metrics", "a34_multi_domain_bootstrap", "a32_stratified_bootstrap",
    "n4_stop_decision", "n5_earliest_stop", "n7_next_item_weighted", "p16_rounded_result", "s6_stream_scoring",
    "i1_document_fingerprint", "j2_targets_and_predictions",
]
PREPARED = [
    ("answers", tables.answers), ("norms", tables.norms), ("scored", tables.scored), ("responses", tables.responses),
    ("predictions", tables.predictions), ("item_pool", tables.item_pool), ("selected", tables.selected), ("answer_log", tables.answer_log),
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    for name, build in PREPARED:
        timed(f"prepare_{name}", lambda: build(spark, sf_dir))
    for name in HEADLINE:
        # the noop sink computes every column of every row without collecting them
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
