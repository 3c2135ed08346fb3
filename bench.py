"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line. Each query is written to a sink that drops the rows."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent))
from tallyspark.plans import catalogue  # noqa: E402

QUERIES = [
    "monthly_category_rollup", "monthly_net_after_pairs", "fuzzy_dedup_merge", "exact_dedup_keep_first", "transfer_pairs", "card_payment_pairs", "timing_pairs",
    "spending_near_duplicates", "total_builder", "sign_corrected", "validate_rows", "clean_description", "parse_amounts", "ofx_roundtrip", "cross_month_impact",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    catalogue.queries()["dataset_summary"](spark, sf_dir).collect()  # the session's start is not the queries'
    for name in QUERIES:
        began = time.time()
        catalogue.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(Path(sf_dir).name.removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
