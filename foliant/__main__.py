"""Commands: parse, match, dataset, training, funnel, counters, pool, labels, reviews, features."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from foliant.plans.pipeline import Batch


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m foliant", description="Runs a step of the batch and those before it; finished steps are read again.")
    p.add_argument("command", choices=["parse", "match", "dataset", "training", "funnel", "counters", "pool", "labels", "reviews", "features"])
    p.add_argument("--out", required=True, help="folder for results")
    p.add_argument("--catalogue", help="catalogue XML")
    p.add_argument("--books", help="JSON lines of books")
    p.add_argument("--authors", help="JSON lines of authors")
    p.add_argument("--reviews", help="JSON lines of reviews")
    p.add_argument("--chart", help="CSV of chart rows")
    p.add_argument("--limit", type=int, help="parse: read only so many records")
    p.add_argument("--min-year", type=int, help="parse: leave out undated and older records")
    p.add_argument("--partitions", type=int, help="spread gzip files over so many tasks")
    p.add_argument("--csv", action="store_true", help="also write the result as CSV")
    p.add_argument("--report", action="store_true", help="parse: also write the coverage report as JSON")
    p.add_argument("--force", action="store_true", help="build again what exists")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("foliant").getOrCreate()
    batch = Batch(spark, a.out, a.catalogue, a.books, a.authors, a.reviews, a.chart, a.partitions, a.force)
    if a.command == "parse":
        table = batch.translations(limit=a.limit, min_year=a.min_year)
        if a.report:
            batch.report(batch.coverage(), "coverage_report")
    else:
        table = {"match": batch.matched, "dataset": batch.matched_dataset, "training": batch.training, "funnel": batch.funnel, "counters": batch.counters, "pool": batch.pool, "labels": batch.labels, "reviews": batch.stats, "features": batch.features}[a.command]()
    if a.csv:
        batch.export(table, a.command)
    print(f"{a.command}: {table.count()} rows")


if __name__ == "__main__":
    main()
