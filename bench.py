"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed (``noop`` sink: every row computed, nothing
collected to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]

    from shredkit.registry import queries
    from shredkit.session import build_session

    spark = build_session(
        f"local[{cpus}]",
        app_name="shredkit-bench",
        shuffle_partitions=int(cpus) * 2,
        extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    qs = queries()
    # Warm the JVM (class loading, JIT, generated-code cache) on the smallest
    # tables, outside the timed runs: the timings are steady-state per query.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name, fn in qs.items():
            if not only or name in only:
                try:
                    fn(spark, warm_dir).write.format("noop").mode("overwrite").save()
                except Exception:  # the timed run reports it
                    pass
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # keep measuring the others; report the failure
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            continue
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        **({"failed": failed} if failed else {}),
    }))


if __name__ == "__main__":
    main()
