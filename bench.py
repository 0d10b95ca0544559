"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom import get_session  # noqa: E402
from riskloom.catalog import load_all  # noqa: E402

HEADLINE = [
    "a05_bureau_balance_rollup", "a06_bureau_rollup", "a07_previous_rollup", "a08_installment_rollup", "a09_pos_rollup", "a10_card_rollup",
    "a11_feature_table", "pt01_stratified_split", "pt03_territory_partition", "pt04_segment_partition", "d03_feature_shift",
    "g04_orphan_report", "g09_structural_loan", "g12_validate", "g18_mean_propagation", "e07_round1_statistics", "e11_shared_transform",
    "m01_roc_auc", "m09_pooled_metrics", "m12_paired_bootstrap", "m13_seed_summary", "h01_blend_weights", "c03_calibration_test",
    "e12_node_encoders",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = get_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"}
    )
    registry = load_all()
    spark.read.parquet(f"{folder}/region.parquet").count()  # session start is not part of any query
    seconds: dict[str, float] = {}
    for name in [n for n in HEADLINE if len(sys.argv) < 2 or n.split("_")[0] in sys.argv[1:]]:
        start = time.perf_counter()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
