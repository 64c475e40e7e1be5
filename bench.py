"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line.

Each query is built from the raw tables and executed to completion with the
``noop`` sink (no driver collection), so the time covers the whole plan,
including its stage materialisations.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_corpus",
    "feature_table",
    "cardinality_audit",
    "shares_summary",
    "boxplot_stats",
    "density_shares",
    "topic_flags",
    "tfidf_top",
    "ngrams",
    "corpus_triple",
    "topic_coherence",
    "topic_exclusivity",
    "topic_correlation",
    "topic_exemplars",
    "fit_ctm",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from corpuslab.plans.queries import QUERIES
    from corpuslab.session import build_session

    spark = build_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    spark.range(1000).selectExpr("sum(id)").collect()  # warm the JVM so the first query is not charged for start-up
    times: dict[str, float] = {}
    for name in names:
        if name not in QUERIES:
            continue
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
