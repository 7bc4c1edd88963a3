"""Command line: ``python -m marlstone.cli scrape URL --name NAME --out FOLDER --pages PARQUET``, ``list``, ``delete``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import site
from .plans import site as plan
from .sources import web


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="marlstone")
    sub = p.add_subparsers(dest="what", required=True)
    scrape = sub.add_parser("scrape", help="a document set from a site")
    scrape.add_argument("url")
    scrape.add_argument("--name", required=True)
    scrape.add_argument("--out", required=True)
    scrape.add_argument("--pages", help="a table of fetched pages (url, html); without it sitemaps are fetched")
    scrape.add_argument("--max-pages", type=int, default=site.MAX_PAGES)
    scrape.add_argument("--workers", type=int, default=10)
    for name in ("list", "delete"):
        one = sub.add_parser(name)
        one.add_argument("--root", required=True)
        if name == "delete":
            one.add_argument("name")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("marlstone").getOrCreate()
    if a.what == "list":
        for x in site.catalog(spark, a.root).withColumn("mb", site.size_mb(F.col("size_bytes"))).orderBy("name").collect():
            print(f"{x['name']}\t{x['total_pages']} pages\t{x['mb']} MB\t{x['source_url']}")
        return 0
    if a.what == "delete":
        return 0 if site.delete_docset(spark, a.root, a.name) else 1
    pages = spark.read.parquet(a.pages) if a.pages else web.site_pages(spark, a.url, a.max_pages, a.workers)
    print(plan.build_docset(pages, a.url, a.out, a.name, max_pages=a.max_pages))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
