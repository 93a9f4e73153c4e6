"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = """entry_units_to_slots jn_07 jn_08 pl_02 pl_03 pl_04 pl_05 pl_07 pl_08 pl_09 pl_14 pl_16 pl_17 pl_21 pl_22 pl_23
ag_04 ag_06 ag_07 ag_12 ag_20 wn_01 wn_03 wn_04 so_02 so_04 ex_01 jn_10 jn_11 jn_16 jn_18 fn_10 fn_16""".split()


def rows_per_second(counts: dict[str, int], seconds: dict[str, float]) -> dict[str, float]:
    """Units per second of the three figures the baseline states."""
    return {k: round(counts[k] / seconds[k], 1) for k in ("pl_04", "pl_05", "pl_09") if k in counts and k in seconds}


def main() -> None:
    from popweave.catalog import QUERIES
    from popweave.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores=cpus, partitions=max(8, int(cpus)))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    seconds, counts = {}, {}
    for key in only:
        start = time.time()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.time() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(key, seconds[key], file=sys.stderr, flush=True)
    for key, table in (("pl_04", "orders"), ("pl_05", "lineitem"), ("pl_09", "customer")):
        if key in seconds:
            counts[key] = spark.read.parquet(f"{folder}/{table}.parquet").count()
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "units_per_second": rows_per_second(counts, seconds)}))


if __name__ == "__main__":
    main()
