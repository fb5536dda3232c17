"""Whole scans: stored pages and snapshots with advertising put in, to findings and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import hidden as H
from ..sources import html as W
from ..sources import snapshots as SN
from . import scan as P
from .registry import pick, query, sql_text, table

#: Markup put first into the body, its place and the technique that finds it there.
PAGES = [
    ('<div class="x1" style="display:none">온라인카지노 가입 문의</div>', "body > div.x1", "OFFSCREEN"),
    ('<div class="x2" style="opacity:0.01">토토사이트 추천</div>', "body > div.x2", "TRANSPARENT"),
    ('<p class="x3" style="color:#fff">바카라사이트 바로가기</p>', "body > p.x3", "TRANSPARENT"),
    ('<p class="x4">ㅋㅏㅈㅣㄴㅗ 가입 문의</p>', "body > p.x4", "JAMO"),
    ('<p class="x5">ｃａｓｉｎｏ 무료 쿠폰</p>', "body > p.x5", "HOMOGLYPH"),
    ('<p class="x6">오늘의 공지 사항</p>', "", ""),
    ('<div class="x7" style="position:absolute;left:-9999px"><b>먹튀검증</b> 안전놀이터</div>', "body > div.x7", "OFFSCREEN"),
    ('<div class="x8" style="font-size:0">꽁머니 지급</div>', "body > div.x8", "OFFSCREEN"),
    ('<div class="x9" style="visibility:hidden">사설토토 총판</div>', "body > div.x9", "ETC"),
    ('<div class="xa" style="display:none">경찰, 불법 도박 단속 안내</div>', "", ""),
    ('<nav><div class="xb" style="display:none">카지노사이트 안내</div></nav>', "", ""),
    ('<p class="xc">zkwlsh 추천 무료</p>', "body > p.xc", "ETC"),
    ('<div class="xd" style="position:absolute;clip:rect(0px,0px,0px,0px)">릴게임 바다이야기</div>', "body > div.xd", "ETC"),
]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored pages as they are, with a case put first into each body."""
    return with_cases(table(spark, sf_dir, "pages"))


#: Names of the extra types of the cases that have one.
EXTRA_OF = {"x9": "VISIBILITY_HIDDEN", "xc": "KEYBOARD_LAYOUT", "xd": "CLIPPED"}


def marked(markup: str, technique: str) -> str:
    """A case that says what should be found in it."""
    name = markup.partition('class="')[2].partition('"')[0]
    mark = f'data-expect-extra="{EXTRA_OF[name]}"' if technique == "ETC" else f'data-expect="{technique}"'
    return markup.replace("class=", f"{mark} class=", 1) if technique else markup


def with_cases(pages: DataFrame, marks: bool = False) -> DataFrame:
    put = F.concat(F.lit("<body>"), pick([marked(x[0], x[2]) if marks else x[0] for x in PAGES], F.col("page_id")))
    return pages.select("page_id", "url", F.replace(F.col("html"), F.lit("<body>"), put).alias("html"))


# What stored text holds beside the cases (look-alike letters in running text) has no SQL form: both are held against loops in the tests.
@query()
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a scan over stored HTML."""
    return P.scan(_pages(spark, sf_dir)).findings.select("page_id", "location", "technique")


@query()
def scan_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the four core techniques, counted from the report."""
    rows = P.report(P.scan(_pages(spark, sf_dir), extras=False))
    return rows.groupBy("technique").agg(F.count("id").alias("n"))


@query()
def eval_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of a scan of pages that say where something should be found."""
    rows = E.metrics(P.judged(with_cases(table(spark, sf_dir, "pages"), marks=True)))
    return rows.select("label", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_TEXTS = ["토토사이트 추천 안전놀이터", "경찰 단속 검거 카지노사이트", "도서관 휴관 안내", "성인용품 할인 카톡 abc", "바카라 이벤트"]
_HIT = [1, 0, 0, 1, 1]


@query(f"SELECT page_id, 1 AS e, 'OFFSCREEN' AS technique, 'display:none' AS method FROM pages WHERE [{', '.join(map(str, _HIT))}][(page_id % 5) + 1] = 1 AND page_id % 4 <> 3")
def scan_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden roots of frame snapshots; every fourth lies in a menu."""
    t = pick(_TEXTS, F.col("page_id"))
    menu = F.when(F.col("page_id") % 4 == 3, "1").otherwise("0")
    json = F.concat(
        F.lit('{"truncated":false,"later":1,"holders":[{"e":2,"t":"'), t, F.lit('","ph":-1,"dn":1,"vis":-1,"clip":-1}],"roots":{"1":{"t":"'), t,
        F.lit('","n":30,"d":4,"p":-1,"m":'), menu, F.lit("}}}"),
    )
    snaps = table(spark, sf_dir, "pages").select("page_id", F.lit(0).alias("frame_id"), json.alias("json"))
    return H.detect(["OFFSCREEN"], SN.holders(snaps), SN.roots(snaps)).select("page_id", "e", "technique", "method")


@query("SELECT page_id, len(regexp_extract_all(html, '<li>'))::INTEGER AS items, len(regexp_extract_all(html, '<a href'))::INTEGER AS links FROM pages")
def html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that the tree builder finds, against the tags in the text."""
    @F.pandas_udf("items int, links int")
    def run(html: pd.Series) -> pd.DataFrame:
        tags = [[e.tag for e in W.Tree(h).elements] for h in html]
        return pd.DataFrame({"items": [t.count("li") for t in tags], "links": [t.count("a") for t in tags]})

    return table(spark, sf_dir, "pages").select("page_id", run("html").alias("v")).select("page_id", "v.*")


@query(f"SELECT page_id, {sql_text('article > h1')} AS location FROM pages")
def css_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selector of each page's heading."""
    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        trees = [W.Tree(h) for h in html]
        return pd.Series([W.selector(t, next(e for e in t.elements if e.tag == "h1")) for t in trees])

    return table(spark, sf_dir, "pages").select("page_id", run("html").alias("location"))


@query()
def html_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holders of the pages with advertising put in."""
    holders, _, _ = W.tables(W.read_frames(_pages(spark, sf_dir)))
    return holders.select("page_id", "frame_id", "e", "t", "dn", "vis", "clip")
