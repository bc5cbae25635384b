"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "opportunities", "best_upside", "resolve_cascade", "fuzzy_name_match", "size_variant_match", "quote_latest",
    "quote_asof", "rolling_24h", "bid_transitions", "alert_dedup", "listing_merge", "budget_cut", "market_health",
    "jsonld_fields", "scan_opportunities",
)


def main() -> None:
    from spreadlake import checks
    from spreadlake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="spreadlake-bench")
    queries, _ = checks.load()
    # start the executors, the code generator and the table readers before the clock
    queries["market_health"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
