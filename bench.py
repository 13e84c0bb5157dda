"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from veilscan.plans import catalog

HEADLINE = [
    "rule_hits_visible", "flag_rate_by_rule", "split_units", "score_spans", "screen_verdicts_by_source", "apply_cuts", "guard_decisions",
    "rate_by_set", "nearest_rank_ms", "threshold_sweep", "localisation", "usage_merge", "step_durations", "unsafe_actions",
    "html_hidden_layers", "glyph_hidden_kind", "lexical_english_ratio", "plant_inbox", "check_items",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus) \
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false") \
        .config("spark.sql.session.timeZone", "UTC").config("spark.veilscan.textPartitions", cpus).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        t = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(os.path.normpath(sf_dir))}))


if __name__ == "__main__":
    main()
