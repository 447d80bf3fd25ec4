"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from preflens.frames import session  # noqa: E402
from preflens.plans import fixtures, registry  # noqa: E402

HEADLINE = (
    "rating_report", "ranking_report", "ndcg_exp_log2", "auc", "group_auc", "stratified_split", "timestamp_split",
    "k_core", "neg_per_positive", "loo_test_batches", "pop_negatives", "cooccurrence", "sim_jaccard", "sar_topk",
    "diversity", "serendipity", "novelty", "dot_score_topk", "tfidf", "weighted_edges", "context_pairs", "link_auc",
    "target_encode", "recent_history", "libffm",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": str(2 * int(cpus)),
        "spark.ui.enabled": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    wanted = sys.argv[1:] or HEADLINE
    queries["acc"](spark, sf).collect()  # start the JVM workers once
    for name in wanted:
        for made in vars(fixtures).values():  # every query makes its own inputs, whatever ran before
            getattr(made, "cache_clear", lambda: None)()
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
