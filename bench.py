"""Headline queries on the bench tables; prints one JSON line.

Each query runs once to warm up the JVM and once on the clock, into the
``noop`` sink so that every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from findry.plans import QUERIES  # noqa: E402
from findry.session import get_session  # noqa: E402

HEADLINE = (
    "knn_dot",
    "knn_cosine",
    "ivf_search_all_cells",
    "rerank_hits",
    "term_index",
    "bm25_search",
    "bm25_title_search",
    "evaluate_bm25",
    "evaluate_knn_graded",
    "build_corpus",
    "build_qrels",
    "split_pairs",
    "build_examples",
    "mine_negatives",
    "normalize_text",
    "simple_tokens",
    "chunk_tokens",
    "augment_mask",
    "sample_negatives",
    "embed_documents",
    "semantic_search",
    "rag_messages",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
