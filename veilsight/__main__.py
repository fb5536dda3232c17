"""Command line: scans stored pages and writes the result files."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import urls as U
from .operators import findings
from .operators.crawl import EXIT_CODES
from .operators.frontier import in_scope
from .plans import run, scan
from .sources import sinks
from .sources.tables import release

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veilsight", description=__doc__)
    p.add_argument("pages", help="Parquet table with page_id, url, html")
    p.add_argument("--entry", default="", help="scan only pages on the host of this address")
    p.add_argument("--out", default="out")
    p.add_argument("--css", help="style sheet that all pages use")
    p.add_argument("--max-pages", type=int)
    p.add_argument("--minutes", type=float, help="end within this time, with what has been judged by then")
    p.add_argument("--no-extra", action="store_true")
    p.add_argument("--dictionary", help="folder with keyword files")
    p.add_argument("--topic", default="")
    p.add_argument("--quiet", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("veilsight").getOrCreate()
    started = datetime.now(timezone.utc).astimezone()
    pages = spark.read.parquet(a.pages).select("page_id", "url", "html")
    if a.entry:
        entry = spark.range(1).select(U.entry(F.lit(a.entry)).alias("url"))
        if entry.first()["url"] is None:
            print("not a web address:", a.entry, file=sys.stderr)
            return EXIT_CODES["INVALID_INPUT"]
        pages = in_scope(pages, "url", entry, "url")
    if a.max_pages is not None:
        pages = pages.orderBy("page_id").limit(a.max_pages)
    css = open(a.css, encoding="utf-8").read() if a.css else ""
    done = run.run(pages, css, not a.no_extra, a.dictionary, a.minutes)
    rows = scan.report(done.result) if done.result else None
    head = sinks.meta(a.topic, a.entry, started, datetime.now(timezone.utc).astimezone(), VERSION)
    sinks.write_results(rows, a.out, head, run=done.head(), review=sinks.open_review(a.out), extras=not a.no_extra)
    if not a.quiet:
        print(f"{done.status} {done.message}".strip())
        if done.result:
            print("\n".join(sinks.summary_lines(findings.summary(done.result.findings))))
    release()
    return done.exit_code


if __name__ == "__main__":
    sys.exit(main())
