"""Runs that end in time, are stopped or fail."""

import json
import time

import pytest
from pyspark.sql import functions as F

from veilsight import __main__ as cli
from veilsight.plans import run, scan
from veilsight.sources import tables

AD = '<body><p class="a">ㅋㅏㅈㅣㄴㅗ 가입</p></body>'


@pytest.fixture
def pages(spark):
    rows = [(k, f"http://e.com/{k // 2}", AD) for k in range(40)]  # two pages with each address
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def rows_of(result):
    return {(r["page_id"], r["url"], r["location"]) for r in result.findings.collect()}


def test_parts_find_what_one_scan_finds(pages):
    whole, limited = run.run(pages), run.run(pages, minutes=60, parts=4)
    assert (whole.status, limited.status) == ("COMPLETED", "COMPLETED") and limited.exit_code == 0
    assert whole.counts == {"pages": 40, "truncated": 0, "parts_judged": 1, "parts": 1} and limited.counts["parts_judged"] == 4
    assert rows_of(whole.result) == rows_of(limited.result) == {(2 * k, f"http://e.com/{k}", "body > p.a") for k in range(20)}
    assert scan.report(limited.result).count() == 20


def test_no_part_begins_after_the_soft_limit(pages, monkeypatch):
    monkeypatch.setattr(run.crawl, "time_budget", lambda minutes: (0.0, 600.0))
    got = run.run(pages, minutes=10)
    assert (got.status, got.exit_code, got.result, got.counts["parts_judged"]) == ("BUDGET", 0, None, 0) and "8 of 8" in got.message


def test_jobs_end_at_the_hard_limit(spark, pages):
    @F.udf("string")
    def slow(h):
        time.sleep(3)
        return h

    mark, began = tables.written(), time.monotonic()
    got = run.run(pages.coalesce(1).withColumn("html", slow("html")), minutes=0.05)
    assert time.monotonic() - began < 40 and (got.status, got.result) == ("BUDGET", None)
    tables.release(mark)
    assert tables.written() == mark and spark.range(3).count() == 3  # later jobs run


def test_an_error_is_told(pages):
    got = run.run(pages.withColumn("html", F.raise_error(F.lit("broken page"))))
    assert (got.status, got.exit_code, got.result) == ("ERROR", 1, None) and "broken page" in got.message


def test_a_stop_keeps_what_is_judged(pages, monkeypatch):
    calls, judge = [], scan.scan_tables

    def stop(*args, **more):
        calls.append(1)
        if len(calls) > 2:
            raise KeyboardInterrupt
        return judge(*args, **more)

    monkeypatch.setattr(run.scan, "scan_tables", stop)
    got = run.run(pages, minutes=60)
    assert (got.status, got.exit_code, got.counts["parts_judged"]) == ("STOPPED", 0, 2) and got.result.findings.count() > 0


def test_command_line_writes_how_it_ended(spark, pages, tmp_path, monkeypatch):
    pages.write.parquet(f"{tmp_path}/p")
    assert cli.main([f"{tmp_path}/p", "--out", f"{tmp_path}/o", "--quiet", "--minutes", "30"]) == 0
    report = json.loads((tmp_path / "o" / "report.json").read_text(encoding="utf-8"))
    assert report["status"] == "COMPLETED" and report["pages"] == 40 and len(report["findings"]) == 20
    monkeypatch.setattr(run.crawl, "time_budget", lambda minutes: (0.0, 600.0))
    assert cli.main([f"{tmp_path}/p", "--out", f"{tmp_path}/q", "--quiet", "--minutes", "30"]) == 0
    report = json.loads((tmp_path / "q" / "report.json").read_text(encoding="utf-8"))
    assert report["status"] == "BUDGET" and report["findings"] == []
    assert cli.main([f"{tmp_path}/p", "--out", f"{tmp_path}/r", "--entry", "ftp://e.com"]) == 2
