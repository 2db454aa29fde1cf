"""Command line: ``python -m tradeweave load RAW_DIR OUT_DIR [--first-year Y --last-year Y]``.

Cleans the landed raw files of RAW_DIR (see ``sources.landed``), loads the star
schema into OUT_DIR (a shared folder; facts partitioned by year, base cube) and
writes the data-quality report to OUT_DIR/quality_report.
"""

from __future__ import annotations

import argparse

from tradeweave.operators.quality import quality_report_frame
from tradeweave.plans.warehouse import PipelineConfig, load_warehouse
from tradeweave.sources.files import write_report
from tradeweave.sources.landed import landed_inputs


def main(argv: list[str] | None = None, spark=None) -> int:
    ap = argparse.ArgumentParser(prog="tradeweave")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ld = sub.add_parser("load", help="clean landed files and load the warehouse")
    ld.add_argument("raw_dir")
    ld.add_argument("out_dir")
    ld.add_argument("--first-year", type=int, default=None)
    ld.add_argument("--last-year", type=int, default=None)
    args = ap.parse_args(argv)

    if spark is None:
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.appName("tradeweave-load").getOrCreate()
    cfg = PipelineConfig()
    if args.first_year is not None and args.last_year is not None:
        cfg = PipelineConfig(years=(args.first_year, args.last_year))
    wh = load_warehouse(spark, landed_inputs(spark, args.raw_dir), args.out_dir, cfg)
    st = wh.staging
    report = quality_report_frame({"trade_flows": st["trade_flows"], "mirror_flows": st["mirror_flows"],
                             "country_stats": st["country_stats"], "hs_chapters": st["hs_chapters"],
                             "country_mapping": st["countries"]})
    write_report(spark, report, f"{args.out_dir.rstrip('/')}/quality_report")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
