"""Steps over many rows, deep trees, rings, nested frames and odd links, against plain loops."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from veilsight.functions import urls as U
from veilsight.operators import findings, frontier, hidden, measure
from veilsight.sources import html, tables
from veilsight.streaming import scan_stream


def test_numbers_are_unique_and_in_order(spark):
    n = 100_000
    rows = spark.range(n).select(
        F.concat(F.lit("http://e.com/"), (F.col("id") * 7919 % 3001).cast("string")).alias("url"), F.concat(F.lit("p:nth-of-type("), F.col("id").cast("string"), F.lit(")")).alias("location"),
        F.when(F.col("id") % 3 == 0, "ETC").otherwise("JAMO").alias("technique"), F.when(F.col("id") % 3 == 0, "X").alias("extra_type"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = findings.numbered(rows).select("id", "url", "location", "technique", "core").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    got["n"] = got["id"].str[2:].astype(int)
    for _, part in got.groupby("core"):
        part = part.sort_values("n")
        assert part["n"].tolist() == list(range(1, len(part) + 1))
        keys = list(zip(part["url"].str.removeprefix("http://"), part["location"]))
        assert keys == sorted(keys)


def slow_up(parent):
    out = set()
    for e in parent:
        a, seen = parent.get(e), set()
        while a is not None and a not in seen:
            seen.add(a)
            out.add((e, a))
            a = parent.get(a)
    return out


@pytest.mark.parametrize("shape", ["chain", "bush", "ring"])
def test_closure_at_any_depth(spark, shape):
    rng = random.Random(1)
    parent = {1: None} | {e: e - 1 if shape == "chain" else rng.randrange(1, e) for e in range(2, 1301)}
    if shape == "ring":
        parent = {1: 3, 2: 1, 3: 2, 4: 3, 5: 4, 6: None, 7: 6}
    df = spark.createDataFrame([(0, 0, e, p) for e, p in parent.items()], "page_id long, frame_id int, e int, p int")
    got = [(r["e"], r["anc"]) for r in hidden.closure(df).collect()]
    assert len(set(got)) == len(got) and set(got) == slow_up(parent)


def test_closure_of_many_elements(spark):
    """A million elements, more pairs than a recursive query may return."""
    df = spark.range(1_000_000).select(F.floor(F.col("id") / 1000).alias("page_id"), F.lit(0).alias("frame_id"), (F.col("id") % 1000).cast("int").alias("e"))
    df = df.withColumn("p", F.when(F.col("e") > 0, F.floor((F.col("e") - 1) / 2).cast("int")))
    depth = sum((e + 1).bit_length() - 1 for e in range(1000))
    assert hidden.closure(df).count() == 1000 * depth


def test_style_at_any_depth(spark):
    rng = random.Random(2)
    parent = {1: None} | {e: max(1, e - rng.randrange(1, 3)) for e in range(2, 1500)} | {5000: 5001, 6000: 6001, 6001: 6000}
    op, none = {e: rng.choice([1.0, 1.0, 0.999]) for e in parent}, {e: rng.random() < 0.01 for e in parent}
    df = spark.createDataFrame([(0, e, p, op[e], none[e]) for e, p in parent.items()], "page_id long, e int, p int, op double, none boolean")
    got = {r["e"]: (r["cum"], r["none_root"]) for r in measure.accumulated(df).collect()}
    assert set(got) == {e for e in parent if e < 5000}
    for e in got:
        cum, near, a = 1.0, None, e
        while a is not None:
            cum, near, a = cum * op[a], near if near is not None else a if none[a] else None, parent[a]
        assert got[e] == (pytest.approx(cum), near)


BASES = ["http://h.org/a/b/c.html?q=/x/y#f", "http://h.org", "https://h.org:8/a/", "http://h.org/a/b/./c"]
LINKS = ["b.html", "../c.html?x=1#y", "./d", "/e/../f", "?p=1", "//o.net/z", "../../../../g", "..", ".", "h/./i/../j", "/", "/../k", "l?m=../n", "é/ü", "a/b/..", "http://x.y/z/../w"]


def test_links_resolve_as_in_a_browser(spark):
    rows = [(b, u) for b in BASES for u in LINKS]
    got = spark.createDataFrame(rows, "b string, u string").select("b", "u", U.resolve("b", "u").alias("v")).collect()
    for r in got:
        assert r["v"] == (r["u"] if "://" in r["u"] else urljoin(r["b"], r["u"])), (r["b"], r["u"])
    odd = ["", " ", "#x", "mailto:a@b", "javascript:void(0)", "x:y"]
    assert all(r["v"] is None for r in spark.createDataFrame([(u,) for u in odd], "u string").select(U.resolve(F.lit(BASES[0]), "u").alias("v")).collect())


def test_links_of_four_forms(spark):
    page = "<body><a href='b.html'>1</a><a href=../c.html>2</a><area href=\"d.html\"><a href=//o.net/e>3</a><a href=b.html>again</a></body>"
    df = spark.createDataFrame([(1, "http://h.org/x/y.html", page)], "page_id long, url string, html string")
    want = ["http://h.org/x/b.html", "http://h.org/c.html", "http://h.org/x/d.html", "http://o.net/e"]
    assert [r["link"] for r in frontier.links(df).orderBy("ord").collect()] == want
    assert [r["link"] for r in frontier.tree_links(html.read_frames(df)).orderBy("ord").collect()] == want


def test_frames_to_the_last_and_no_mixing(spark):
    """Six frames deep, a page in its own frame, two stored pages with one address."""
    frame = lambda u: f'<body><iframe src="{u}"></iframe><p style="display:none">text {u}</p></body>'
    rows = [(k, f"http://h.org/{k}", frame(f"/{k + 1}")) for k in range(6)] + [(6, "http://h.org/6", frame("/0"))]
    rows += [(7, "http://h.org/3", "<body><p style='display:none'>another text</p></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.read_frames(df).select("page_id", "frame_id", "prefix", F.transform("holders", lambda h: h["t"]).alias("t")).collect()
    assert len({(r["page_id"], r["frame_id"]) for r in got}) == len(got)
    per_page = {}
    for r in got:
        per_page.setdefault(r["page_id"], []).append(r)
    assert {k: len(v) for k, v in per_page.items()} == {**{k: 7 for k in range(7)}, 7: 1}
    deepest = max(per_page[0], key=lambda r: r["prefix"].count(">>>"))
    assert deepest["prefix"].count(">>>") == 6 and deepest["t"] == ["text /0"]
    inline = "<p>deep 카지노</p>"
    for _ in range(6):
        inline = '<iframe srcdoc="' + inline.replace("&", "&amp;").replace('"', "&quot;") + '"></iframe>'
    assert len(html.frames(f"<body>{inline}</body>", "http://h.org/")) == 7


def test_stream_scans_a_page_once(spark, tmp_path):
    page = '<body><p class="a">ㅋㅏㅈㅣㄴㅗ 가입</p></body>'
    for k in range(3):
        rows = [(k, f"http://e.com/{k}", page), (10 + k, "http://e.com/same?b=1&a=2", page), (20 + k, "http://e.com/same?a=2&b=1#x", page)]
        spark.createDataFrame(rows, scan_stream.PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = tables.written()
    q = scan_stream.scan_stream(scan_stream.read_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4 and tables.written() == before


def test_release_removes_what_was_written(spark):
    import os

    mark = tables.written()
    where = tables.stored(spark.range(3), "t").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(where)
    tables.release(mark)
    assert not os.path.exists(where) and tables.written() == mark
