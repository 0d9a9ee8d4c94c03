"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The search facts are first stored by month, as a load leaves them, and the three
benchmark payloads (total, daily, by query; clicks, impressions, click rate and
position of one page over four weeks) are asked of the stored facts, as are the
same three over everything. The other queries read the sample tables directly.

Each query runs once to warm up and then three times; the median counts. Rows
are written to the no-op sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid
from dataclasses import replace
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = {
    "daily_clicks": "daily_click_report",
    "ratios_daily": "d3_ratio_metrics",
    "ads_monthly": "e1_monthly",
    "ads_by_group": "e3_relation_label",
    "latest_snapshot": "f2_latest_snapshot_resilient",
    "snapshot_delta": "f3_snapshot_delta",
    "kpi_tree": "k1_kpi_daily_cost",
    "merge_largest": "j4_merge_largest",
    "global_status": "l1_global_status",
}
METRICS = {m: m for m in ("clicks", "impressions", "ctr", "position")}
FOUR_WEEKS = ("1998-03-31", "1998-04-28")
PAYLOADS = {"total": [], "daily": ["daily"], "by_query": ["query"]}
RUNS = 3


def median_seconds(build) -> float:
    taken = []
    for _ in range(RUNS + 1):
        started = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - started)
    return round(statistics.median(taken[1:]), 4)


def main() -> None:
    from pyspark.sql import functions as F

    from tidemark import AggregateRequest, aggregate
    from tidemark.queries import REGISTRY
    from tidemark.session import local_session, shared_folder
    from tidemark.sources import files
    from tidemark.sources import tables as T

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "tidemark-bench")
    times: dict[str, float] = {}

    stored = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}/facts"
    started = time.perf_counter()
    facts = T.search_facts(spark, folder).withColumn("metric_config_id", F.xxhash64("name", "page_id", "query_id", "device_id", "dimension_set_id"))
    files.write_facts(facts.drop("dims"), stored)
    star = T.search_star(spark, folder)
    star.dimension_sets.write.parquet(f"{stored}-sets")
    star = replace(star, dimension_sets=spark.read.parquet(f"{stored}-sets"))
    load = round(time.perf_counter() - started, 4)

    table = spark.read.parquet(stored)

    def ask(groups, filters, dates):
        return aggregate(replace(star, facts=table), AggregateRequest(METRICS, groups, filters, *dates))

    for label, groups in PAYLOADS.items():
        filters = {"page": 3, "dimensions.searchAppearance": "O"}
        times[label] = median_seconds(lambda g=groups, f=filters: ask(g, f, FOUR_WEEKS))
        times[f"{label}_all"] = median_seconds(lambda g=groups: ask(g, {}, (None, None)))
    for label, name in HEADLINE.items():
        times[label] = median_seconds(lambda n=name: REGISTRY[n].build(spark, folder))

    scale = float(Path(folder).name.removeprefix("sf"))
    total = round(sum(times.values()), 4)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "load": load, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
