"""Headline queries, warm, median of three; prints one JSON line.

``BENCH_SF_DIR``, ``BENCH_CPUS`` and ``BENCH_RUNS`` select the tables, the threads and the
number of runs. Results go to a sink that computes every row and keeps none. The views that give
the given tables the shape of review data are written as tables first, outside the clock; with
``BENCH_VIEWS=inside`` each query derives them again, as rounds 1 and 2 measured.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from reviewlake.plans.fixtures import prepare, view
from reviewlake.plans.registry import load_all
from reviewlake.session import local_session
from reviewlake.sources.folders import release, shared_folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = set(filter(None, os.environ.get("BENCH_QUERIES", "").split(",")))
    spark = local_session()
    inside = os.environ.get("BENCH_VIEWS") == "inside"
    if not inside:
        prepare(spark, sf_dir, shared_folder(spark, "views"))
    seconds: dict[str, float] = {}
    for name, query in load_all().items():
        if not (name in only if only else query.headline):
            continue
        samples = []
        for attempt in range(runs + 1):
            started = time.perf_counter()
            query.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt or runs == 0:  # the first run only warms up
                samples.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(samples), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    findings = view(spark, sf_dir, "raw_findings").select("review_id").distinct().count()
    report = seconds.get("report_severity_summary")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "views": "inside" if inside else "prepared", "reviews_with_findings": findings,
        "reviews_summarised_per_minute": round(findings / report * 60) if report else None}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
