"""Time the headline queries and print one JSON line.

Every query runs completely into a sink that discards the rows. One small query
runs first, so that session start is not part of a figure.
"""

from __future__ import annotations

import json
import os
import time

from verbatim.plans import catalog, topics
from verbatim.session import local_session

HEADLINE = [
    "word_counts", "word_counts_by", "top_n_by_group", "ngram_counts", "ngram_counts_by", "bigram_edges", "tf_idf",
    "top_tf_idf_by_group", "polarity_word_counts_by", "response_mean_score", "segment_polarity", "sentence_sentiment",
    "sentiment_by_response", "comparison_terms", "boxplot_stats", "density_ridges", "bar_order", "fit_lda", "fit_topics", "fit_topics_converged", "topic_labels_frex", "add_row_id",
    "strip_reply_prefix", "ngrams_over_tokens", "group_sum_keep_rows",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = catalog.queries() | topics.CONVERGED
    queries["word_count"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in only:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
