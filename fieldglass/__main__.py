"""Command line: ``python -m fieldglass views|tables|process|sql|status|groups``."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import SparkSession

from fieldglass.plans.process import process
from fieldglass.sources import catalog, registry


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="fieldglass")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("views", "tables", "process", "sql", "status"):
        p = sub.add_parser(name)
        p.add_argument("--data", default="data")
        if name == "tables":
            p.add_argument("--pbp", action="store_true")
        if name == "process":
            p.add_argument("--out", default="data/processed")
            p.add_argument("--year", type=int, default=datetime.date.today().year)
        if name == "sql":
            p.add_argument("text")
            p.add_argument("--rows", type=int, default=50)
    sub.add_parser("groups")
    args = top.parse_args(argv)
    if args.command == "groups":
        for group, names in registry.GROUPS.items():
            print(f"{group}: {registry.describe(group)} ({', '.join(sorted(names))})")
        return 0
    spark = spark or SparkSession.builder.appName("fieldglass").enableHiveSupport().getOrCreate()
    if args.command == "views":
        for name, path in catalog.register_views(spark, args.data).items():
            print(name, path)
    elif args.command == "tables":
        for name, rows in catalog.create_tables(spark, args.data, args.pbp).items():
            print(name, rows)
    elif args.command == "process":
        for step, outcome in process(spark, args.data, args.out, args.year).items():
            print(step, outcome)
    elif args.command == "sql":
        catalog.register_views(spark, args.data)
        catalog.run_sql(spark, args.text).show(args.rows, truncate=False)
    else:
        for line in registry.status(args.data, spark):
            print(*line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
