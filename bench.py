"""Benchmark: run the headline queries and print one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, optional).
Each query is executed in full through the `noop` sink (no collect to the driver); the time per query is the
best of BENCH_REPEAT runs (default 1) after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

if os.path.basename(os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")) == "sf0.1":
    os.environ.setdefault("EMBERWATCH_DURATION_DIV", "10")  # FIXTURES.md: series are ten times denser than at sf0.01

from emberwatch.plans import catalog  # noqa: E402
from emberwatch.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus) if cpus.isdigit() else 16), app="bench")
    cat = catalog.load_all()
    wanted = os.environ.get("BENCH_QUERIES")
    names = [n.strip() for n in wanted.split(",")] if wanted else sorted(n for n, e in cat.items() if e.bench)

    # warm-up: one Python worker per core (workers are reused), then every headline query on the
    # smallest tables (JVM JIT, codegen cache)
    parts = 2 * (int(cpus) if cpus.isdigit() else 8)
    spark.range(0, parts * 100, numPartitions=parts).mapInPandas(lambda it: it, "id long")\
        .write.format("noop").mode("overwrite").save()
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm):
        for name in names:
            catalog.run(name, spark, warm).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()

    times = {}
    for name in names:
        best = None
        for _ in range(repeat):
            spark.catalog.clearCache()  # no query may profit from another's persisted intermediates
            t0 = time.perf_counter()
            catalog.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
