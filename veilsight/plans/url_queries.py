"""Queries over URLs, links and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import frontier as FR
from ..sources import html
from . import sqlgen as S
from .registry import pick, query, sql_pick, sql_text, table

#: What is put after the stored URLs so that all rules meet cases.
SUFFIXES = ["", "#part", ";jsessionid=0A1B?b=2&a=1", "?b=2&&a=1", "/index.html", "?page=7", "?page=99999999999", "/a/b/c/d/e/board/", "/file.PDF", "/?act=logout", "//", "?lang=ko&pg=3"]
ENTRIES = ["example.com", "example.com:8080/x", "mailto:a@b.c", " http://Example.COM/x ", "ftp://x.y", "", "a b.com", "javascript:void(0)", "https://u:p@Host:443/", "http://", "www.example.org/?q"]

_U = f"(SELECT page_id, url || {sql_pick(SUFFIXES, 'page_id')} AS u FROM pages)"


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat("url", pick(SUFFIXES, F.col("page_id"))).alias("u"))


def _url_query(name: str, column, sql: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _urls(spark, sf_dir).select("page_id", "u", column(F.col("u")).alias("v"))

    f.__name__ = name
    query(f"SELECT page_id, u, {sql} AS v FROM {_U}")(f)


for _name, _column, _sql in (
    ("url_clean", U.clean, S.clean("u")),
    ("url_key", U.key, S.key("u")),
    ("url_host", U.host, S.host("u")),
    ("url_bare_host", U.bare_host, S.bare_host("u")),
    ("url_is_http", U.is_http, S.is_http("u")),
    ("url_visit_key", U.visit_key, S.visit_key("u")),
    ("url_path_query", U.path_query, S.path_query("u")),
    ("url_page_number", U.page_number, S.page_number("u")),
    ("url_list_family", U.list_family, S.list_family("u")),
    ("url_destructive", U.destructive, S.destructive("u")),
    ("url_is_file", U.is_file, S.is_file("u")),
    ("url_score", lambda u: U.score(u, F.lit(2)), S.score("u", "2")),
    ("url_blocked_resource", U.blocked_resource, S.has("u", U.BLOCKED_RESOURCES)),
):
    _url_query(_name, _column, _sql)


@query(f"SELECT page_id, e, {S.entry('e')} AS v FROM (SELECT page_id, {sql_pick(ENTRIES, 'page_id')} AS e FROM pages)")
def url_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").select("page_id", pick(ENTRIES, F.col("page_id")).alias("e"))
    return df.select("page_id", "e", U.entry("e").alias("v"))


#: Markup put first into each body, so that all forms of links meet cases.
ANCHORS = [
    '<a href="b.html">', "<a class=x href='../c.html?x=1&amp;y=2#z'>", "<a href=d/./e.html>", '<area href="../../../../f">', "<a href=//other.example/g>", '<a href="?page=2">',
    '<a href="/h/../i/">', "<a href=mailto:a@b.c>", '<a download href="j.zip">', '<a href="#top">', '<a href="x:y">', "<a href='..'>", '<a href=" k l.html ">', "<A HREF=.>",
]
_WITH_LINKS = f"(SELECT page_id, url, replace(html, '<body>', '<body>' || {sql_pick(ANCHORS, 'page_id')} || {sql_pick(ANCHORS, 'page_id // 7')}) AS html FROM pages)"
_VISIBLE = S.sub("html", r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>")
_TAGS = f"unnest(regexp_extract_all({_VISIBLE}, '(?i)<(?:a|area)\\b[^>]*>'))"
_HREF = "replace(" + " || ".join(f"regexp_extract(tag, {sql_text(FR.HREF)}, {k})" for k in (1, 2, 3)) + ", '&amp;', '&')"
_LINKS = (
    f"(SELECT page_id, url, ord, {S.resolve('url', 'href')} AS link FROM (SELECT page_id, url, ord, {_HREF} AS href, tag"
    f" FROM (SELECT page_id, url, {_TAGS} AS tag, unnest(range(1, len(regexp_extract_all({_VISIBLE}, '(?i)<(?:a|area)\\b[^>]*>')) + 1)) AS ord FROM {_WITH_LINKS}))"
    f" WHERE NOT {S.has('tag', '(?i)\\sdownload\\b')} AND {S.has('tag', FR.HREF)})"
)
_FIRST_LINKS = f"(SELECT page_id, url, link, min(ord)::INTEGER AS ord FROM {_LINKS} WHERE link IS NOT NULL GROUP BY ALL)"


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    put = F.concat(F.lit("<body>"), pick(ANCHORS, n), pick(ANCHORS, F.floor(n / 7)))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.replace(F.col("html"), F.lit("<body>"), put).alias("html"))


@query(f"SELECT page_id, link, ord FROM {_FIRST_LINKS}")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.links(_linked(spark, sf_dir)).select("page_id", "link", "ord")


@query(f"SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY ord)::INTEGER AS n FROM {_FIRST_LINKS}")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages by the tree, in order, without repeats."""
    rows = FR.tree_links(html.read_frames(_linked(spark, sf_dir)))
    return rows.select("page_id", "link", F.row_number().over(Window.partitionBy("page_id").orderBy("ord")).alias("n"))


_SCOPE = f"(SELECT DISTINCT {S.bare_host('url')} AS h FROM pages WHERE contains(url, '/en/'))"


@query(f"SELECT page_id, url FROM pages WHERE {S.bare_host('url')} IN (SELECT h FROM {_SCOPE})")
def scope_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return FR.in_scope(pages, "url", pages.where("contains(url, '/en/')"), "url").select("page_id", "url")


_VISITABLE = f"(SELECT page_id, link, ord FROM {_FIRST_LINKS} WHERE {S.bare_host('link')} IN (SELECT h FROM {_SCOPE}) AND NOT {S.is_file('link')} AND NOT {S.destructive('link')})"


@query(f"SELECT page_id, link, ord FROM {_VISITABLE}")
def link_visitable(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _linked(spark, sf_dir)
    return FR.visitable(FR.links(pages), "link", pages.where("contains(url, '/en/')"), "url").select("page_id", "link", "ord")


_OFFERS = f"(SELECT page_id AS ord, (page_id % 4)::INTEGER AS depth, u AS url FROM {_U} UNION ALL SELECT page_id + 1000000, 1, url FROM pages)"
_NEW = f"(SELECT ord, depth, url, {S.visit_key('url')} AS vkey, {S.list_family('url')} AS family FROM {_OFFERS} QUALIFY row_number() OVER (PARTITION BY vkey ORDER BY ord) = 1)"
_FAMILY = "coalesce(family, vkey)"


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _urls(spark, sf_dir).select(F.col("page_id").alias("ord"), (F.col("page_id") % 4).cast("int").alias("depth"), F.col("u").alias("url"))
    again = table(spark, sf_dir, "pages").select((F.col("page_id") + 1000000).alias("ord"), F.lit(1).alias("depth"), "url")
    return first.unionByName(again)


@query(f"SELECT ord, depth, vkey FROM {_NEW}")
def frontier_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.first_offers(_offers(spark, sf_dir)).select("ord", "depth", "vkey")


# one family for every path, so that the cap is met at any scale
_BROAD = f"(SELECT ord, depth, url, vkey, 'h' || (ord % 3) AS family FROM {_NEW})"


@query(f"SELECT ord, vkey, family FROM {_BROAD} QUALIFY row_number() OVER (PARTITION BY family ORDER BY ord) <= 30")
def frontier_family_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = FR.first_offers(_offers(spark, sf_dir)).withColumn("family", F.concat(F.lit("h"), (F.col("ord") % 3).cast("string")))
    return FR.cap_families(new).select("ord", "vkey", "family")


_QUEUE = f"(SELECT ord, depth, {S.clean('url')} AS url, {S.score('url', 'depth')} AS score, vkey FROM {_NEW} QUALIFY family IS NULL OR row_number() OVER (PARTITION BY family ORDER BY ord) <= 30)"


@query(f"SELECT ord, depth, url, score FROM {_QUEUE}")
def frontier_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.offer(_offers(spark, sf_dir)).select("ord", "depth", "url", "score")


@query(f"SELECT ord, depth, url, score FROM {_QUEUE} ORDER BY score, ord LIMIT 20")
def frontier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.take(FR.offer(_offers(spark, sf_dir)), 20).select("ord", "depth", "url", "score")


@query(
    f"WITH k AS MATERIALIZED (SELECT * FROM {_QUEUE}) SELECT ord, score FROM k WHERE NOT contains(url, '?') UNION ALL"
    f" SELECT ord + 10000000, score + 1000 FROM k WHERE contains(url, '?') AND vkey NOT IN (SELECT vkey FROM k WHERE contains(url, 'page='))"
)
def frontier_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = FR.offer(_offers(spark, sf_dir))
    query = F.contains("url", F.lit("?"))
    refused, before = queue.where(query), queue.where("contains(url, 'page=')").select("vkey")
    return FR.requeue(queue.where(~query), refused, before, 10000000).select("ord", "score")


@query(f"SELECT ord, vkey FROM {_NEW} WHERE vkey NOT IN (SELECT {S.visit_key('url')} FROM pages WHERE contains(url, '?'))")
def frontier_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages reached by redirects count as seen."""
    seen = table(spark, sf_dir, "pages").where("contains(url, '?')").select(U.visit_key("url").alias("vkey"))
    return FR.unseen(FR.first_offers(_offers(spark, sf_dir)), seen).select("ord", "vkey")
