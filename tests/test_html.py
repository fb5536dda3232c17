from veilsight.sources import html as W


def test_left_out_end_tags():
    t = W.Tree("<body><p>a<p>b<ul><li>c<li>d</ul><table><tr><td>1<td>2<tr><td>3</table></body>")
    assert [(e.tag, e.parent.tag) for e in t.elements if e.tag in ("p", "li", "td", "tr")] == [
        ("p", "body"), ("p", "body"), ("li", "ul"), ("li", "ul"), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr")
    ]


def test_scripts_are_no_text():
    s = W.snapshot('<body><script>var t="</p>카지노";</script><p>카지노abc 문의</p></body>')
    assert [h["t"] for h in s["holders"]] == ["카지노abc 문의"]


def signals(html, css=""):
    return [{k: v for k, v in h.items() if k in ("dn", "fs", "off", "op", "ca", "sc", "vis", "clip") and v is not None} for h in W.snapshot(html, css)["holders"]]


def test_hiding():
    one = lambda style: set(signals(f'<body><div style="{style}">카지노abc</div></body>')[0])
    assert one("display:none") == {"dn"}
    assert one("font-size:0.5px") == {"fs"}
    assert one("position:absolute;left:-9999px") == {"off"}
    assert one("text-indent:-2000px") == {"off"}
    assert one("opacity:0.05") == {"op"}
    assert one("color:transparent") == {"ca"}
    assert one("color:#fefefe") == {"sc"}
    assert one("color:#fefefe;background:#000") == set()
    assert one("visibility:hidden") == {"vis"}
    assert one("overflow:hidden;height:1px") == {"clip"}
    assert one("color:red") == set()
    assert one("color:transparent;-webkit-text-stroke:1px red") == set() and one("color:#fff;-webkit-text-stroke-width:2px") == set()
    assert one("color:transparent;-webkit-text-stroke:0 red") == {"ca"}
    assert one("color:transparent;background:#000 url(x.png);-webkit-background-clip:text") == set()
    assert one("color:transparent;background:linear-gradient(red,blue) text") == set()
    assert one("-webkit-text-fill-color:transparent;background-clip:text;opacity:0.01") == {"op"}


def test_cascade():
    css = ".a .b{opacity:.2} p.c{color:#fff} .d{background:#fff url(x.png)}"
    got = signals('<body><div class="a" style="opacity:.4"><p class="b">카지노abc</p></div><p class="c">토토abc</p><div class="d"><p class="c">토토abcd</p></div></body>', css)
    assert [set(g) for g in got] == [{"op"}, {"sc"}, set()]
    assert round(got[0]["op"]["v"], 3) == 0.08


def test_inner_root_and_parents():
    s = W.snapshot('<body><div style="display:none">토토abc <p style="display:none">카지노abc</p></div></body>')
    inner = [h for h in s["holders"] if h["t"] == "카지노abc"][0]
    assert s["roots"][inner["dn"]]["p"] is not None and inner["ph"] is not None


def test_selectors_lead_to_one_element():
    t = W.Tree('<body><div class="x"><p>a</p><p>b</p></div><div class="x"><p>c</p></div><p class="y 1z">d</p></body>')
    paths = [W.selector(t, e) for e in t.elements if e.tag == "p"]
    assert len(set(paths)) == 4 and paths[3] == "body > p.y" and all(paths)


def test_links():
    t = W.Tree(
        '<base href="/d/"><a href="x.html">1</a><a href="#t">2</a><a href="mailto:a@b">3</a><a download href="f">4</a><p onclick="location.href=\'/k\'">5</p>'
        '<i data-url="//h/q">6</i><meta http-equiv="refresh" content="3; url=/r"><script>window.open("/s")</script><a href="x.html">7</a>'
    )
    assert W.links(t, "http://e.com/a") == ["http://e.com/d/x.html", "http://e.com/k", "http://h/q", "http://e.com/r", "http://e.com/s"]


def test_frames(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://e.com/a", '<body><iframe src="/b"></iframe><iframe srcdoc="&lt;p class=\'q\'&gt;카지노abc&lt;/p&gt;"></iframe></body>'),
            (2, "http://e.com/b", '<body><p class="z">토토abc</p></body>'),
        ],
        "page_id long, url string, html string",
    )
    _, _, selectors = W.tables(W.read_frames(pages))
    got = {(r["page_id"], r["location"]) for r in selectors.collect()}
    assert (1, 'iframe[src="http://e.com/b"] >>> body > p.z') in got and (2, "body > p.z") in got
    assert any(p == 1 and s.startswith("body > iframe:nth-of-type(2) >>> ") for p, s in got)
    spark.catalog.clearCache()


def test_scan_reads_what_stored_pages_hold(spark, tmp_path):
    from veilsight.plans import scan_queries as Q

    put = ['<p class="y">ㅋㅏㅈㅣㄴㅗ 가입 문의</p>', '<p class="y">ｃａｓｉｎｏ 무료 쿠폰</p>', '<div class="y" style="display:none">온라인카지노 가입 문의</div>', '<p class="y">café résumé</p>']
    pages = [(5 + 13 * k, f"http://a.example/{k}", f"<html><body>{x}</body></html>") for k, x in enumerate(put)]  # with the case that holds nothing
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in Q.scan_pages(spark, str(tmp_path)).collect()}
    assert got == {(5, "body > p.y", "JAMO"), (18, "body > p.y", "HOMOGLYPH"), (31, "body > div.y", "OFFSCREEN")}
    assert {r["t"] for r in Q.html_holders(spark, str(tmp_path)).collect()} >= {"온라인카지노 가입 문의"}
