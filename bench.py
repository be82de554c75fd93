"""Headline queries, timed; prints one JSON line.

Every query runs to a sink that takes all rows. The best of two runs counts, after the
session has started.
"""

from __future__ import annotations

import json
import os
import time

from songloom.registry import QUERIES
from songloom.session import local_session

HEADLINE = (
    "dedup_first",
    "plays_to_unique_counts",
    "library_both",
    "cache_lookup",
    "enrich_full",
    "enrich_summary",
    "enrich_forced",
    "lyric_lookup_best",
    "cache_upsert",
    "document_text",
    "hash_encode",
    "index_upsert",
    "vector_topk",
    "vector_topk_batch",
    "vector_topk_all",
    "text_topk_batch",
    "keyword_batch",
    "search_results",
    "lyric_keyword_search",
    "listing_plays",
    "listing_enriched",
    "normalize_liked",
    "normalize_plays",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "total seconds of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
