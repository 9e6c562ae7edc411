"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "canonical_cells",
    "name_index",
    "normalized_coverings",
    "resolve_cells",
    "resolve_top_three",
    "rows_inside_structures",
    "encode_brain_points",
    "encode_body_points",
    "sphere_density",
    "resolve_corpus",
    "browse_by_anatomy",
    "term_route_links",
    "matched_citations",
    "points_in_solids",
    "same_place_pairs",
]


def main():
    from bodygrid.plans import load
    from bodygrid.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus)) if cpus.isdigit() else 8, app="bench")
    reg = load()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock
    times = {}
    for name in HEADLINE:
        t = time.time()
        reg.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
