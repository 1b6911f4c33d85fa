"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from queries import load_all  # noqa: E402
from tidymill.plans.session import local_session  # noqa: E402

HEADLINE = (
    "an_mom_change", "an_cohort_retention", "an_pareto_customers", "an_moving_average", "an_cumulative_sum", "an_rank_within_group", "an_distribution", "an_correlation",
    "profile_columns", "quality_score", "clean_full_name", "clean_date", "clean_phone", "clean_email", "clean_amount", "clean_quantity", "clean_status", "multi_value_explode",
    "clean_organisation", "clean_url", "clean_measurements", "resolve_missing", "missing_between_neighbours", "validate_rules", "referential_integrity", "dedupe_exact", "dedupe_documents",
    "duplicates_partial", "duplicates_fuzzy", "forward_fill", "compare_datasets", "derived_metrics", "chart_timeseries", "chart_grouped", "chart_correlation", "basic_clean",
    "column_roles", "clean_global", "clean_category", "clean_text", "full_clean")


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus, partitions=int(cpus), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    registry, times = load_all(), {}
    registry[HEADLINE[0]][0](spark, sf_dir).collect()   # start the JVM's compilers before the clock
    for name in HEADLINE:
        start = time.time()
        registry[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "session": {"cpus": int(cpus), "shuffle_partitions": int(cpus), "driver_memory": "16g", "adaptive": True}}))
    spark.stop()


if __name__ == "__main__":
    main()
