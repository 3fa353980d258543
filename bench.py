"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores)
choose the data and the local cores; BENCH_RUNS (default 3) the timed runs, of
which the median counts.  BENCH_QUERIES may name the queries to run, or ``all``.
Each query is executed completely (the no-op sink) after one untimed run.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tarmac.catalogue.all import QUERIES
from tarmac.catalogue.roles import collision
from tarmac.functions.predicates import TimeFilter
from tarmac.operators import kpi
from tarmac.plans import dashboard
from tarmac.session import build_session, scratch_path, shared_folder
from tarmac.sources import tables

HEADLINE = (
    "kpi_monthly",
    "kpi_daily",
    "kpi_year",
    "kpi_yoy",
    "kpi_range",
    "monthly_trend_adjusted",
    "map_points",
    "hotspots",
    "hotspots_radius",
    "cell_drilldown",
    "demographics",
    "factor_severity",
    "factor_pivot",
    "casualty_mix",
    "master",
    "fk_orphans",
    "decode_label",
    "bng_to_wgs84",
    "point_in_polygon",
    "within_distance",
    "nearest_count",
    "khop_smooth",
    "stacked_totals",
    "age_band_sex",
    "hour_daytype",
    "asof_lookback",
    "make_model_year",
    "column_profile",
    "first_per_key",
)


def overview_page(spark, sf_dir: str, runs: int) -> float:
    """Totals with the year-on-year change, then the trend, from stored aggregates."""
    stored = {
        "kpi_monthly": tables.materialise(kpi.kpi_monthly(collision(spark, sf_dir)), scratch_path(spark, "kpi-monthly")),
        "kpi_daily": tables.materialise(kpi.kpi_daily(collision(spark, sf_dir)), scratch_path(spark, "kpi-daily")),
    }

    def run() -> float:
        start = time.perf_counter()
        for part in dashboard.overview(stored, TimeFilter(year=1998), ["Fatal", "Serious"]).values():
            part.collect()
        return time.perf_counter() - start

    run()
    return round(statistics.median(run() for _ in range(runs)), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split() or list(HEADLINE)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_folder(spark)

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings: dict[str, float] = {}
    for name in names:
        run(name)
        timings[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    if not chosen:
        timings["overview_page"] = overview_page(spark, sf_dir, runs)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
                "state": "warm, median",
            }
        )
    )


if __name__ == "__main__":
    main()
