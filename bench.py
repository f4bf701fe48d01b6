"""Time the headline queries: one JSON line, seconds per query (median of warm runs)."""

from __future__ import annotations

import json
import os
import statistics
import time

from probatum.session import session
from workload import QUERIES

HEADLINE = ["vocabulary_report", "rule_vocabulary", "rule_references", "rule_bare_figures", "rule_terms", "rule_assessments",
            "rule_relations", "rule_range_collapse", "prose_claims", "match_keys", "unique_slugs", "resolved_relations",
            "graph_degrees", "claim_contradictions", "back_link_pages", "transcripts", "page_texts", "changed_orders",
            "suspicious_people", "similar_names", "resolved_names", "search_results", "corpus_health", "facet_values",
            "publish_bare_figures", "evidence_subgraph", "event_timeline", "change_volume", "duplicate_findings", "held_sources"]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = session(f"local[{cpus}]", "bench", spark_ui_enabled="false", spark_sql_shuffle_partitions=cpus,
                    spark_driver_memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({"metric": "headline queries, warm median", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": root.rsplit("sf", 1)[-1], "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()
