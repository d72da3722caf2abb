"""Time the headline queries, the least of ``RUNS`` each: one JSON line on standard output."""

import json
import os
import time

from obsframe.plans import QUERIES
from obsframe.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = 2
NAMES = """a01_observations_in_order c02_records_newest_first d03_family_lookup e01_digit_frequency e08_coverage_summary
e15_independence e23_store_snapshot f02_rolling_statistics f03_rolling_digit_frequency f08_recency f15_observation_density
k04_change_trends m01_pair_relations m05_regime_windows n01_symbol_ranking n02_tail_ranking n03_pair_ranking
o01_probability_scores p03_prequential_rows q07_history_dataset q07_modelling_rows
r01_record_checks""".split()


def main() -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["e23_store_snapshot"](spark, FOLDER).collect()  # start the session before timing
    times = {}
    for name in NAMES:
        runs = []
        for _ in range(RUNS):
            start = time.time()
            QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(min(runs), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": FOLDER.rsplit("/sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
