"""Headline timings: prints one JSON line.

Runs the main jobs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``.  Each query is executed to completion through the
no-op sink (full evaluation, no collection to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pairwright import fixed_values as FV  # noqa: E402
from pairwright.operators import selection as SEL  # noqa: E402
from pairwright.plans import catalog as C  # noqa: E402
from pairwright.session import get_session  # noqa: E402

HEADLINE = ("clean_pairs", "build_final", "stage_counts", "evaluation_set", "score_describe",
            "reference_scores", "training_set", "indel_ratio", "cluster_prompts", "dedupe_keep_first",
            "evaluate", "greedy_profile_match", "select_prompts")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", app_name="pairwright-bench", shuffle_partitions=int(cpus),
                        conf={"spark.driver.memory": "16g"})
    qs = C.all_queries()
    # warm-up: JVM, Python workers, parquet footers
    run(qs["strip_text"](spark, sf_dir))
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        run(qs[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
    # one greedy step of the prompt selection (a distributed best-candidate scan)
    scores = C._scores(spark, sf_dir).select(F.col("vec_id").alias("id"), "scores").persist()
    n_cand = scores.count()
    seed = scores.orderBy("id").first()
    t0 = time.time()
    SEL.best_candidate(scores, list(seed["scores"]), 1, FV.TARGET_SCORES, [seed["id"]])
    times["greedy_step"] = round(time.time() - t0, 3)
    # indel ratio throughput on all pairs
    pairs = C.full_pairs(spark, sf_dir).persist()
    n_pairs = pairs.count()
    total = sum(times.values())
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(total, 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus),
                      "candidates": n_cand, "pairs": n_pairs,
                      "indel_pairs_per_sec": round(n_pairs / times["indel_ratio"], 1)}))


if __name__ == "__main__":
    main()
