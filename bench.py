"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the threads.
``BENCH_QUERIES`` (comma separated, or ``all``) picks other queries.
Each query is planned, run and its whole result consumed.  ``setup``, part of
the total, is the writing of the stored balances, which the weighted queries
then read; ``locate_facts`` is the join that locates facts at load.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from ballotlake.plans.registry import registry
from ballotlake.sources.events import event_tables

HEADLINE = [
    "block_at", "blocks_at_poll_ends", "valid_votes_all", "latest_votes_all", "unique_voters_all",
    "canonical_votes", "canonical_votes_all", "merged_votes", "current_vote_all", "current_votes_all",
    "active_proxies_block", "canonical_voter_cut", "token_holders_time", "locked_balances_time",
    "combined_balances_time", "voting_weights_time", "canonical_weight", "weighted_votes_time",
    "tally_time", "tally_all", "tally_block", "lock_history_totals_all", "all_locks_running",
    "shutdown_joins_v1", "running_balances_wallet", "balances_at_votes", "integrity_report",
    "locate_facts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"{os.path.dirname(os.path.abspath(__file__))}/spark-warehouse/bench")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE

    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    start = time.perf_counter()
    tables = event_tables(spark, sf_dir)
    tables.wallet_balance, tables.locked_balance  # noqa: B018 - written at first use
    setup = time.perf_counter() - start

    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, wall time", "value": round(setup + sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "setup": round(setup, 3), "sf": os.path.basename(sf_dir.rstrip("/")),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
