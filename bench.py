"""Headline queries on a written star schema; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the driver's tables, BENCH_CPUS the local cores. The star is
built and written once (``write_star``, part of the total); each query then runs BENCH_RUNS times and its best time
counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.filter_queries import MEASURES  # noqa: E402
from checks.matrix_queries import LISTED, PER_ITEM, PER_PATIENT  # noqa: E402
from checks.sample import Sample, build_star  # noqa: E402
from scriptline.plans import analysis  # noqa: E402
from scriptline.plans.model import Model, read_star  # noqa: E402
from scriptline.session import job_folder, local_session  # noqa: E402

HEADLINES = {
    "org_date_ratio": lambda m: analysis.org_date_ratio(m, PER_ITEM),
    "org_date_ratio_patients": lambda m: analysis.org_date_ratio(m, PER_PATIENT),
    "deciles": lambda m: analysis.deciles(m, PER_ITEM),
    "practice_date_matrix": lambda m: analysis.practice_date_matrix(m, LISTED, 96),
    "medication_date_matrix": lambda m: analysis.medication_date_matrix(m, LISTED, 96),
    "top_medications_other": lambda m: analysis.top_medications_other(m, LISTED),
    "measure_panel": lambda m: analysis.measure_panel(m, MEASURES),
    "measure_deciles": lambda m: analysis.measure_deciles(m, MEASURES),
}


def star_model(sample: Sample) -> Model:
    return read_star(sample.spark, build_star(sample), sample.model.orgs, sample.model.members, sample.catalogue)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), **{"spark.ui.showConsoleProgress": "false"})
    sample = Sample(spark, sf_dir)
    sample.model  # catalogues and organisations are there before the star is built
    models: list[Model] = []
    built = timed(lambda: models.append(star_model(sample)))
    model = models[0]
    times = {
        name: min(timed(lambda: build(model).write.format("noop").mode("overwrite").save()) for _ in range(runs))
        for name, build in HEADLINES.items()
    }
    times["write_star"] = built
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {name: round(t, 3) for name, t in times.items()},
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
