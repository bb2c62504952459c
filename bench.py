"""Bench: run the headline queries on $BENCH_SF_DIR (default sf0.1) with
local[$BENCH_CPUS] and print one JSON line with per-query seconds.

Each query is forced to completion with the no-op sink (the whole result is
computed, nothing is collected); model queries run their fitting passes
when called. Session start-up is excluded: before timing, the flagship
query runs once on the tiny sf0.001 tables so class loading and JIT
warm-up (about 8 s in a fresh JVM) are not charged to the first query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from abundance.plans.queries import QUERIES  # noqa: E402
from abundance.session import get_spark  # noqa: E402

HEADLINE = [
    "species_true_zeros", "max_n", "abundance_richness", "benthos_composition", "relief_moments",
    "habitat_cover", "size_class_abundance", "zero_fill_grid", "mismatch_report", "describe_habitat",
    "corr_matrix", "model_report", "hist_30", "glm_site", "glm_lineitem", "zip_depth", "full_subsets",
    "glm_models", "zip_models", "spline_prediction", "describe_events_exact", "glmm_models",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        QUERIES["species_true_zeros"][0](spark, warm).write.format("noop").mode("overwrite").save()
    else:
        spark.range(1000).selectExpr("sum(id)").collect()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    times = {}
    for name in names:
        fn = QUERIES[name][0]
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
