"""Run a whole study: python -m tidemark --codes 1=AAA,2=BBB [--data DIR] [--out DIR]"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from tidemark.config import ANNOUNCEMENTS_FILE, StudyConfig, data_dir
from tidemark.operators import quality, taxonomy
from tidemark.plans.study import Study
from tidemark.sources import announcements, bars, sinks


def main() -> None:
    args = argparse.ArgumentParser(prog="tidemark")
    args.add_argument("--codes", required=True, help="scrip codes and symbols, as 1=AAA,2=BBB")
    args.add_argument("--data", help="folder with <SYMBOL>.csv and " + ANNOUNCEMENTS_FILE)
    args.add_argument("--out", default="outputs")
    args.add_argument("--shared", help="folder that driver and executors share, for intermediate tables; needed unless spark.checkpoint.dir is set")
    args.add_argument("--refresh", action="store_true", help="read the bars' CSV files anew, whatever the cache holds")
    given = args.parse_args()
    codes = {int(c): s for c, s in (pair.split("=") for pair in given.codes.split(","))}
    cfg = replace(StudyConfig(), scrip_codes=codes)
    folder = given.data or str(data_dir())
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.shared:
        spark.conf.set("spark.checkpoint.dir", given.shared)
    elif not spark.conf.get("spark.checkpoint.dir", None):
        args.error("name the folder that driver and executors share by --shared or spark.checkpoint.dir")
    raw = bars.read_raw_csv(spark, folder, sorted(codes.values()))
    kept = bars.cached_bars(bars.derive(bars.first_of_each(raw)), f"{given.out}/cache/bars", given.refresh)
    feed = announcements.read_announcements(spark, f"{folder}/{ANNOUNCEMENTS_FILE}", codes)
    audit = quality.bar_checks(kept, cfg, raw).union(quality.announcement_checks(feed, kept, cfg))
    tables = Study(kept, taxonomy.classify(announcements.unique(feed)), cfg).run()
    sinks.write_tables({"data_quality_audit": audit, **tables}, f"{given.out}/tables")
    print(sinks.report({"data quality": audit, **{k: tables[k] for k in ("subject_summary", "subject_tests", "pead_summary", "placebo", "clean_peers")}}))


if __name__ == "__main__":
    main()
