"""Headline timings: one JSON line. Data from $BENCH_SF_DIR, on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.registry import QUERIES  # noqa: E402
from rarespark.session import build_session  # noqa: E402

HEADLINE = ["row_scores", "breakdown_all", "row_scores_6d", "row_scores_grouped", "threshold_sweep", "flagged_summary",
            "prep_full_chain", "prep_scale_robust", "fe_qcut", "prep_ordinal", "column_summary", "compare_runs",
            "isolation_forest"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, where: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    run("row_scores", small if os.path.isdir(small) else sf_dir)  # start the JVM's compilers
    times = {name: run(name, sf_dir) for name in HEADLINE}
    scale = re.search(r"sf([\d.]+)$", sf_dir.rstrip("/"))
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale.group(1)) if scale else None}))


if __name__ == "__main__":
    main()
