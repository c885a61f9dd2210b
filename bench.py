"""Times the headline queries and prints one JSON line.

Every query is run twice over the tables in $BENCH_SF_DIR and the second run counts, so
JVM start-up and first compilation are left out. Results go to Spark's noop sink, which
computes every row and column.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postlabel.session import local_session  # noqa: E402
from queries import QUERIES  # noqa: E402

HEADLINE = (
    "rule_firing label_posts label_comments skip_report ruleset_diff weak_label_job "
    "dedupe_text cap_random cap_preferring stratified_split split_overlap collect_corpus "
    "newest_per_window class_report model_comparison success_gates error_slices tokenize "
    "naive_bayes top_per_group_large text_features examples_csv error_patterns select_best predict "
    "label_stream dedupe_stream label_counts_stream rule_shadowing paired_report find_error_patterns intake_posts"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=max(8, int(cores)) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
