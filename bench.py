"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Whole queries are timed after a warm-up. Tiers are timed apart: build, refresh after 1 % late rows, and the same aggregate from tiers
and from raw rows, the best of three.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tidemark.operators.engine import EngineConfig
from tidemark.plans import catalogue
from tidemark.sources.tables import table

NAMES = ("slice_mixed_tiers_range", "candle_by_type_1d", "slice_dirty_ranges", "percentile_disc_exact", "topk_groups", "pricing_summary", "product_sum")


def timed(work) -> float:  # noqa: ANN001
    start = time.time()
    work()
    return round(time.time() - start, 3)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="spark-bench-")
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{shared}/checkpoints",
        "spark.sql.warehouse.dir": f"{shared}/warehouse",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, took = catalogue.queries(), {}
    found[NAMES[0]](spark, folder).collect()
    for name in NAMES:
        took[name] = timed(lambda: found[name](spark, folder).write.format("noop").mode("overwrite").save())  # noqa: B023
    events, made = table(spark, folder, "events"), []
    took["build_tiers"] = timed(lambda: made.append(catalogue._events(spark, folder, ["value stats"], base=events.where("event_id % 100 <> 0"))))
    engine = made[0]
    took["insert_late_rows"] = timed(lambda: engine.insert("events", events.where("event_id % 100 = 0")))
    took["refresh_late_rows"] = timed(lambda: engine.refresh("events"))
    for name, worth in (("total_from_raw", 0.0), ("total_from_tiers", 0.9)):
        engine.config = EngineConfig(worth=worth)
        ask = lambda: engine.query("events", catalogue.JAN, catalogue.FEB, [("sum", "value", "s")], by=["event_type"]).collect()
        took[name] = min(timed(ask) for _ in range(3))
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
