"""Suppression against the sequential statement, reviews, sinks, streams, the entry module."""

import datetime as dt
import json
import random
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException

from veilsight.operators import crawl, evaluate, findings, hidden, review
from veilsight.plans import scan
from veilsight.functions import urls as U
from veilsight.sources import results, sinks
from veilsight.streaming import scan_stream


def test_hidden_suppression_against_a_loop(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for page in range(60):
        n = rng.randint(1, 12)
        parent = [None] + [rng.randrange(e) for e in range(1, n)]
        own, rest = [rng.random() < 0.3 for _ in range(n)], [rng.random() < 0.4 for _ in range(n)]
        rows += [(page, 0, e, parent[e], own[e], rest[e]) for e in range(n)]
        covered = set()
        for e in range(n - 1, -1, -1):  # children come after their parents
            if own[e] or rest[e] and e not in covered:
                want.add((page, e))
                p = parent[e]
                while p is not None:
                    covered.add(p)
                    p = parent[p]
    df = spark.createDataFrame(rows, "page_id long, frame_id int, e int, p int, own boolean, rest boolean")
    got = hidden.suppress(df.drop("p"), hidden.closure(df)).select("page_id", "e").collect()
    assert {tuple(r) for r in got} == want


def test_scan_of_nested_and_long_hiding(spark):
    filler = "안내 문장입니다. " * 40
    pages = [
        (1, '<div style="display:none" class="o">토토사이트 추천 <p class="i" style="display:none">꽁머니 지급</p></div>'),
        (2, f'<div style="display:none" class="o">{filler} 카지노 {filler}</div>'),
        (3, '<div style="display:none" class="o">' + "<p>토토사이트 바카라사이트 카지노사이트 슬롯사이트</p>" * 12 + "</div>"),
    ]
    df = spark.createDataFrame([(i, f"http://e.com/{i}", f"<body>{h}</body>") for i, h in pages], "page_id long, url string, html string")
    got = {(r["url"][-1], r["location"], r["technique"]) for r in scan.scan(df).findings.collect()}
    assert ("1", "div.o > p.i", "OFFSCREEN") in got and ("1", "body > div.o", "OFFSCREEN") in got
    assert not any(u == "2" for u, _, _ in got) and ("3", "body > div.o", "OFFSCREEN") in got
    spark.catalog.clearCache()


def test_empty_scan(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert scan.report(scan.scan(df)).count() == 0
    spark.catalog.clearCache()


def test_order_does_not_matter(spark):
    rows = [(k, f"http://e.com/{k % 3}/", "div > p", "JAMO", None, f"t{k}") for k in range(9)]
    schema = "arrival long, url string, location string, technique string, extra_type string, evidence_text string"
    a = findings.collect(spark.createDataFrame(rows, schema)).collect()
    b = findings.collect(spark.createDataFrame(rows[::-1], schema).repartition(3)).collect()
    assert sorted(a) == sorted(b) and len(a) == 3


def test_unknown_status_is_an_error(spark):
    entries = spark.createDataFrame([], review.SCHEMA)
    change = spark.createDataFrame([("k", "odd", "", "now")], "key string, status string, memo string, updated_at string")
    with pytest.raises(PySparkException):
        review.set_status(entries, change).collect()


def test_nothing_to_measure_is_perfect(spark):
    judged = spark.createDataFrame([("p", "JAMO", "fn")], "page string, label string, outcome string")
    rows = {r["label"]: r for r in evaluate.metrics(judged).collect()}
    assert rows["JAMO"]["precision"] == 1.0 and rows["JAMO"]["recall"] == 0.0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://e.com/1", '<body><p class="a">ㅋㅏㅈㅣㄴㅗ 가입 &lt;/script&gt;</p><p class="b">zkwlsh 추천 무료</p></body>')], "page_id long, url string, html string")
    now = dt.datetime(2026, 1, 2, 3, 4, 5, 678901, dt.timezone.utc)
    head = sinks.meta("t", "http://e.com", now, now + dt.timedelta(seconds=1.25), "0")
    assert head["elapsed_sec"] == 1.3 and head["started_at"] == "2026-01-02T03:04:05+00:00"
    rows = scan.report(scan.scan(df))
    sinks.write_results(rows, str(tmp_path), head)
    core, extra = (json.loads((tmp_path / n).read_text(encoding="utf-8")) for n in (sinks.RESULT, sinks.EXTRA))
    assert [f["technique"] for f in core["findings"]] == ["JAMO"] and [f["id"] for f in extra["findings"]] == ["f_001"]
    assert set(core["findings"][0]) == {"id", "url", "is_violation", "location", "evidence_text", "technique"}
    assert "</script>" not in (tmp_path / sinks.PAGE).read_text(encoding="utf-8").split("</script></body>")[0]
    assert sinks.open_review(str(tmp_path)) == {}
    (tmp_path / sinks.REVIEW).write_text("{broken")
    assert sinks.open_review(str(tmp_path)) == {}
    sinks.review_csv(rows, str(tmp_path / "review.csv"))
    text = (tmp_path / "review.csv").read_bytes().decode()
    assert text.startswith("﻿") and "\r\n" in text and len(sinks.parse_csv(text)) == 3
    for _ in range(2):
        sinks.append_history(str(tmp_path / "h.csv"), {"a": 1})
    assert (tmp_path / "h.csv").read_text() == "a\n1\n1\n"
    spark.catalog.clearCache()


def test_stream(spark, tmp_path):
    for k in range(2):
        rows = [(k, f"http://e.com/{k}", '<body><p class="a">ㅋㅏㅈㅣㄴㅗ 가입</p></body>'), (9, "http://e.com/same", "<body></body>")]
        spark.createDataFrame(rows, scan_stream.PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = scan_stream.scan_stream(scan_stream.read_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert scan_stream.findings_so_far(spark, str(tmp_path / "out")).count() == 2
    assert scan_stream.progress(q)["batch"] >= 0


def test_status_and_budget():
    assert crawl.run_status(stopped=True, error=True) == ("ERROR", 1)
    assert crawl.run_status() == ("COMPLETED", 0)
    assert crawl.time_budget(25) == (1440.0, 1500.0) and crawl.time_budget(1) == (48.0, 60.0)


def test_entry_without_the_corpus_operators(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name == 'corpus_pipeline' or name.startswith('veilsight.llm'): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_results_read_back(spark, tmp_path):
    row = {"id": "f_001", "url": "u", "technique": "JAMO", "location": "a > b", "evidence_text": 'x "q",\ny', "extra_finding": None}
    (tmp_path / "result.json").write_text(sinks.result_json([row], {"topic": "t", "elapsed_sec": 1.0}), encoding="utf-8")
    got = results.read_result(spark, str(tmp_path / "result.json")).first()
    assert (got["id"], got["evidence_text"], got["is_violation"]) == ("f_001", 'x "q",\ny', True)
    sinks.write_atomically(str(tmp_path / "v.csv"), "﻿" + sinks.csv_lines([["id", "technique", "url", "location", "evidence_text", "verdict"], ["f_001", "JAMO", "u", "a", 'x "q",\ny', "정탐"]]))
    got = results.read_verdicts(spark, str(tmp_path / "v.csv")).collect()
    assert len(got) == 1 and got[0]["evidence_text"] == 'x "q",\ny' and evaluate.by_hand(results.read_verdicts(spark, str(tmp_path / "v.csv"))).first()["tp"] == 1


def test_error_lines(spark, tmp_path):
    cause = "struct<class:string,message:string,stack:array<string>>"
    rows = [("t", "w", "s", "u", "E", "m", [f"f{k}" for k in range(60)], [("C", "x", ["y"])] * 9)]
    df = spark.createDataFrame(rows, f"time string, thread string, site string, url string, class string, message string, stack array<string>, causes array<{cause}>")
    sinks.error_lines(df).write.text(str(tmp_path / "errors"))
    got = results.read_errors(spark, str(tmp_path / "errors")).first()
    assert len(got["stack"]) == 40 and len(got["causes"]) == 5


def test_key_is_its_own_key(spark):
    urls = ["HTTP://Ex.com:80/a//?b=2&a=1#x", "ex.com/", "https://ex.com:443", "ex.com?b&&a", "", "a;jsessionid=1?x", "//ex.com/a/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(U.key("u").alias("k"))
    assert [r["k"] for r in df.select(U.key("k").alias("k")).collect()] == [r["k"] for r in df.collect()]
