"""Whole scans of the stored pages against sequential loops over parsed pages."""

from collections import Counter

import pytest

from veilsight.operators import verdicts as V
from veilsight.operators.assess import assess
from veilsight.plans import scan_queries as Q
from veilsight.plans.registry import QUERIES
from veilsight.sources import html as W
from veilsight.sources import keywords

WORDS = keywords.load()
#: Check, technique, and the fields of a holder that are its signals.
HIDING = {
    "TRANSPARENT": ("TRANSPARENT", lambda h: [h[k]["r"] for k, top in (("op", 0.1), ("ca", 0.1), ("sc", 1.1)) if h[k] and h[k]["v"] <= top]),
    "OFFSCREEN": ("OFFSCREEN", lambda h: [r for r in (h["dn"], h["fs"] and h["fs"]["r"], h["off"] and h["off"]["r"]) if r is not None]),
    "VISIBILITY": ("ETC", lambda h: [] if h["vis"] is None else [h["vis"]]),
    "CLIPPED": ("ETC", lambda h: [] if h["clip"] is None else [h["clip"]]),
}


def above(parents, e):
    out = []
    while (e := parents.get(e)) is not None:
        out.append(e)
    return out


def slow_texts(holders):
    """Own text first, else the text with children unless a holder below is found."""
    parents = {h["e"]: h["ph"] for h in holders}
    for technique, extra, check in V.TEXT_CHECKS.values():
        own = {h["e"] for h in holders if check(h["t"], WORDS)}
        full = {h["e"] for h in holders if h["e"] not in own and h["f"] and check(h["f"], WORDS)}
        covered = {a for e in own | full for a in above(parents, e)}
        yield from ((e, technique, extra) for e in own | (full - covered))


def slow_hiding(holders, roots):
    parents = {e: r["p"] for e, r in roots.items()}
    ad = lambda t: bool(t) and assess(t, WORDS).hidden_ad_like
    for name, (technique, signals) in HIDING.items():
        held = {}
        for h in holders:
            known = [r for r in signals(h) if r in roots]
            if known:
                held.setdefault(max(known, key=lambda r: roots[r]["d"]), []).append(h)
        own, rest = set(), set()
        for e, hs in held.items():
            r = roots[e]
            if r["m"] == 1 or not assess(r["t"], WORDS).compact(r["n"]):
                continue
            if any(ad(h["t"]) for h in hs):
                own.add(e)
            if any(ad(h["f"]) for h in hs) or r["n"] <= 300 and ad(r["t"]):
                rest.add(e)
        covered = {a for e in own | rest for a in above(parents, e)}
        yield from ((e, technique, name) for e in own | (rest - covered))


def slow_scan(pages):
    found = set()
    for p in pages:
        snap = W.snapshot(p["html"])
        for e, technique, extra in (*slow_texts(snap["holders"]), *slow_hiding(snap["holders"], snap["roots"])):
            if e in snap["selectors"]:
                found.add((p["page_id"], snap["selectors"][e], technique, extra if technique == "ETC" else None))
    return found


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """All pages of the smallest tables and one of the next that holds look-alike letters in its own text."""
    at = str(tmp_path_factory.mktemp("pages"))
    more = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id = 221")
    small = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where("page_id <> 221")
    small.unionByName(more).write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="module")
def expected(spark, folder):
    pages = [r.asDict() for r in Q.with_cases(spark.read.parquet(f"{folder}/pages.parquet")).collect()]
    assert len({p["url"] for p in pages}) == len(pages)
    return slow_scan(pages), pages


def test_scan_against_loops(spark, folder, expected):
    want, _ = expected
    got = [tuple(r) for r in QUERIES["scan_pages"](spark, folder).collect()]
    assert Counter(got) == Counter(w[:3] for w in want)
    assert (221, "HOMOGLYPH") in {(r[0], r[2]) for r in got}


def test_scan_finds_every_case(spark, folder, expected):
    """What has been put in is found where it stands, and cases that hold nothing are left alone."""
    want, pages = expected
    for p in pages:
        _, location, technique = Q.PAGES[p["page_id"] % len(Q.PAGES)]
        put = {w[1:3] for w in want if w[0] == p["page_id"]}
        assert (location, technique) in put if technique else not put or p["page_id"] == 221


def test_report_against_loops(spark, folder, expected):
    want = Counter(w[2] for w in expected[0] if w[2] != "ETC")
    assert {r["technique"]: r["n"] for r in QUERIES["scan_core"](spark, folder).collect()} == want


def test_evaluation_against_loops(spark, folder, expected):
    want, pages = expected
    case = {p["page_id"]: Q.PAGES[p["page_id"] % len(Q.PAGES)][1:] for p in pages}
    right, wrong = Counter(), Counter()
    for page, location, technique, _ in want:
        (right if (location, technique) == case[page] else wrong)[technique] += 1
    missed = Counter(t for page, (location, t) in case.items() if t and (page, location, t) not in {w[:3] for w in want})
    for count in (right, wrong, missed):
        count["TOTAL"] = sum(n for t, n in count.items() if t != "ETC")
    got = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in QUERIES["eval_scan"](spark, folder).collect()}
    assert got == {t: (right[t], wrong[t], missed[t]) for t in (*{k for c in (right, wrong, missed) for k, n in c.items() if n}, "TOTAL")}
    assert wrong["HOMOGLYPH"] >= 1 and right["TOTAL"] >= 25


def test_evaluation_of_marks_in_frames(spark):
    """A right finding, one in two pages' frame, a wrong one, one that is known to be wrong, a missed one, two marks of one element."""
    from pyspark.sql import functions as F

    from veilsight.operators import evaluate as E
    from veilsight.plans import scan

    ad, plain = "온라인카지노 가입 문의", "오늘의 공지 사항"
    hidden = lambda text, mark, name: f'<div class="{name}" style="display:none" {mark}>{text}</div>'
    inner = hidden(ad, 'data-expect=OFFSCREEN', "w")
    whole = [
        (1, "http://e.com/1", "<body>" + hidden(ad, "data-expect='OFFSCREEN JAMO'", "a") + '<iframe src="/w"></iframe></body>'),
        (2, "http://e.com/2", "<body>" + hidden(ad, "", "b") + '<p data-known-fp="x"><b class="c" style="opacity:0">토토사이트 추천</b></p><iframe src="/w"></iframe></body>'),
        (3, "http://e.com/3", "<body>" + hidden(plain, "data-expect-extra=CLIPPED", "d") + f'<iframe srcdoc=\'<p class="z" style="visibility:hidden" data-expect-extra="VISIBILITY_HIDDEN">{ad}</p>\'></iframe></body>'),
        (9, "http://e.com/w", f"<body>{inner}</body>"),
    ]
    pages = spark.createDataFrame(whole, "page_id long, url string, html string")
    got = Counter(tuple(r) for r in scan.judged(pages, alone=F.col("page_id") < 9).collect())
    assert got == Counter(
        {
            (1, "OFFSCREEN", "tp"): 2, (1, "JAMO", "fn"): 1, (2, "OFFSCREEN", "tp"): 1, (2, "OFFSCREEN", "fp"): 1, (2, "TRANSPARENT", "known_fp"): 1,
            (3, "ETC:CLIPPED", "fn"): 1, (3, "ETC:VISIBILITY_HIDDEN", "tp"): 1,
        }
    )
    named = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in E.metrics(scan.judged(pages, alone=F.col("page_id") < 9)).collect()}
    assert named["ETC"] == (1, 0, 1) and named["TOTAL"] == (3, 2, 1)
    odd = spark.createDataFrame([(1, p, "OFFSCREEN", None, k) for k, p in enumerate(["body > div.q", "div", "nothing >>> div", 'iframe[src="http://e.com/w"] >>> body > div.w'])], "page_id long, location string, technique string, extra_type string, arrival int")
    frames = W.read_frames(pages)
    assert {r["arrival"]: r["matches"] for r in E.located(odd, frames, pages).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}
