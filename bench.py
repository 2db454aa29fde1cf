"""Benchmark: load the warehouse once, then time every registered query on it.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.

"load/<step>" = stand-in raw inputs → clean/dedup → key resolution → contiguous
fact keys → Parquet (facts partitioned by year) → base cube. Every other entry
runs one query against that warehouse and drains it with the no-op sink;
"cube/<name>" entries serve the same query from the base cube.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tradeweave.plans.warehouse import STANDIN_CONFIG, load_warehouse  # noqa: E402
from tradeweave.plans.cube import CUBE_SCHEMA, serves_from_cube, with_cube  # noqa: E402
from tradeweave.plans.registry import ON_STAR  # noqa: E402
from tradeweave.sources.standin import load_raw_inputs  # noqa: E402
from tradeweave.session import ensure_checkpoint_dir, local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(4, int(cpus) if cpus.isdigit() else 8), app="tradeweave-bench")
    root = ensure_checkpoint_dir(spark)
    out = f"{root.rstrip('/')}/warehouse-{uuid.uuid4().hex[:8]}"

    times: dict[str, float] = {}
    # each step of the load by itself: cleaning, dimensions, keyed facts, cube
    wh = load_warehouse(spark, load_raw_inputs(spark, sf_dir), out, STANDIN_CONFIG, times=times)
    wh = replace(wh, source_dir=sf_dir)
    for name, impl in ON_STAR.items():
        t = time.time()
        impl(wh).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    # the same dashboard queries served from the base cube written by the load
    cube = with_cube(wh, spark.read.schema(CUBE_SCHEMA).parquet(f"{out}/trade_cube"))
    for name, impl in ON_STAR.items():
        if serves_from_cube(name):
            t = time.time()
            impl(cube).write.format("noop").mode("overwrite").save()
            times[f"cube/{name}"] = round(time.time() - t, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_sec_load_plus_all_queries", "value": total, "unit": "sec", "queries": times,
        "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "n_queries": len(ON_STAR),
        "fact_queries_sec": round(sum(v for k, v in times.items() if k in ON_STAR), 3),
        "cube_queries_sec": round(sum(v for k, v in times.items() if k.startswith("cube/")), 3),
        "spark": spark.version, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "aqe": spark.conf.get("spark.sql.adaptive.enabled"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
