"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "tag_profile", "shipment_tag_profile", "tag_top_values", "asset_totals", "group_by_tags", "infra_by_network", "cloud_by_account",
    "grouping_plan", "full_grouping_plan", "host_clusters", "container_clusters", "component_placement", "service_sync",
    "deployment_links", "deployment_mismatches", "component_deployments", "stale_team_tags", "users_to_create", "team_membership_changes",
    "component_rules", "component_multi_rules", "component_checks", "repeated_keys", "duplicated_components", "declared_components",
    "operation_report", "operation_breakdown", "operation_sample", "name_similarity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tallyline.session import build_session
    from workload.registry import queries

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    names = sys.argv[1:] or HEADLINES
    if names == ["all"]:
        names = list(registered)
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the executor threads outside the timings
    registered[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # so that no query carries the start costs
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
