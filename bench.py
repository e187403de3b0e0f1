"""Time the headline queries: prints one JSON line.

Every query runs twice in one session and the second run counts, so start-up and compilation stay out. BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the local cores.
"""

import json
import os
import sys
import time

from touchline.queries import all_queries
from touchline.session import local_session

HEADLINE = [
    "possession_chains", "chain_outcomes", "action_conversion", "action_features", "next_goal_labels", "action_values",
    "credit_assignment", "segments", "player_totals_c", "view_summary_a", "player_skills", "rolling_form",
    "lineup_ratings", "outcome_scores", "design_rows", "ridge_player_columns", "season_fits", "match_elos",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    times = {}
    queries["partition_report"](spark, folder).collect()  # start-up costs stay out of the first query
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
