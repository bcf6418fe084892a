"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 8).
One query warms the session up; then each is run once, in full, into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "clean_corpus_by_lang",
    "clean_text",
    "dedup_clean_text",
    "corpus_stats",
    "corpus_profile",
    "top_repeated_lines",
    "boilerplate_by_frequency",
    "lines_not_in_list",
    "distinct_raw_text",
    "new_postings_anti",
    "number_rows",
    "topk_blocks_per_page",
    "chunk_to_posting",
    "scan_csv_parts",
    "sink_csv_parts",
    "build_corpus",
    "index_postings",
    "html_body_text",
    "html_links",
    "html_text_blocks",
    "extract_or_quarantine",
    "pretokenize",
    "word_counts",
    "encode_wordpiece",
    "vocab_size",
    "chunk_recursive",
    "embed_chunks",
    "dense_topk",
    "sparse_topk",
    "bm25_topk",
    "hybrid_fuse",
    "recommend_postings",
    "retrieval_metrics",
)


def main() -> None:
    from siftwell.queries import QUERIES
    from siftwell.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # starts the JVM's and the Python workers' machinery outside the timings
    QUERIES["clean_text"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
