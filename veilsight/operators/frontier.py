"""The crawl frontier as relations: links, scope, first offers, caps, priority, second tries.

Every step partitions by a key or pulls a top-k; nothing is ordered globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U

FAMILY_CAP, REQUEUE_PENALTY, MOST_LINKS = 30, 1000, 5000
HREF = r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"


def links(pages: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """``page_id, url, link, ord``: different links of ``a`` and ``area`` per page with the place of the first, absolute.

    Read by patterns in the engine; ``tree_links`` also finds links in scripts and other attributes.
    """
    visible = F.regexp_replace("html", _HIDDEN, "")
    tags = F.regexp_extract_all(visible, F.lit(r"(?i)<(?:a|area)\b[^>]*>"), F.lit(0))
    rows = pages.select("page_id", "url", F.posexplode(tags).alias("ord", "tag"))
    rows = rows.where(~F.col("tag").rlike(r"(?i)\sdownload\b") & F.col("tag").rlike(HREF))
    href = F.replace(F.concat(*[F.regexp_extract("tag", HREF, k) for k in (1, 2, 3)]), F.lit("&amp;"), F.lit("&"))
    rows = rows.select("page_id", "url", (F.col("ord") + 1).alias("ord"), U.resolve("url", href).alias("link"))
    return _first_links(rows, most)


def tree_links(frames: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """The same columns from the ``links`` of parsed frames: anchors, ``onclick``, ``data-`` attributes, refreshes and scripts."""
    rows = frames.select("page_id", "url", "frame_id", F.posexplode("links").alias("at", "link"))
    w = Window.partitionBy("page_id").orderBy("frame_id", "at")  # links of one page
    rows = rows.where(F.col("link").rlike(U.SCHEME))
    return _first_links(rows.select("page_id", "url", "link", F.row_number().over(w).alias("ord")), most)


def _first_links(rows: DataFrame, most: int) -> DataFrame:
    first = rows.where("link is not null").groupBy("page_id", "url", "link").agg(F.min("ord").cast("int").alias("ord"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).where(F.col("n") <= most).drop("n")


def in_scope(df: DataFrame, url: str, entries: DataFrame, entry_url: str) -> DataFrame:
    """Rows whose host, without ``www.``, is the host of an entry."""
    hosts = entries.select(U.bare_host(entry_url).alias("__scope")).distinct()
    return df.withColumn("__host", U.bare_host(url)).join(hosts, F.col("__host") == F.col("__scope"), "left_semi").drop("__host")


def visitable(df: DataFrame, url: str, entries: DataFrame, entry_url: str) -> DataFrame:
    """In scope, no file, no link that changes anything; the cheap tests come before the join."""
    return in_scope(df.where(~U.is_file(url) & ~U.destructive(url)), url, entries, entry_url)


def first_offers(offers: DataFrame) -> DataFrame:
    """Of ``ord, depth, url``, the first offer of each page."""
    keyed = offers.withColumn("vkey", U.visit_key("url"))
    first = keyed.groupBy("vkey").agg(F.min_by(F.struct("ord", "depth", "url"), "ord").alias("o"))
    return first.select("o.ord", "o.depth", "o.url", "vkey", U.list_family("o.url").alias("family"))


def unseen(offers: DataFrame, seen: DataFrame) -> DataFrame:
    return offers.join(seen.select("vkey").distinct(), "vkey", "left_anti")


def cap_families(offers: DataFrame, cap: int = FAMILY_CAP) -> DataFrame:
    """The first ``cap`` offers of each list family; a rejected page stays seen, so this follows ``first_offers``."""
    w = Window.partitionBy("family").orderBy("ord")
    loose = offers.where("family is null")
    return offers.where("family is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n").unionByName(loose)


def offer(offers: DataFrame, cap: int = FAMILY_CAP) -> DataFrame:
    """``ord, depth, url, score, vkey, family``: the queue that these offers make."""
    queue = cap_families(first_offers(offers), cap)
    return queue.withColumn("score", U.score("url", "depth")).withColumn("url", U.clean("url"))


def take(queue: DataFrame, n: int) -> DataFrame:
    """The next pages, by score and then order."""
    return queue.orderBy("score", "ord").limit(n)


def requeue(queue: DataFrame, refused: DataFrame, before: DataFrame, shift: int) -> DataFrame:
    """The queue with refused pages put behind once; those in ``before`` have had their second try."""
    again = refused.join(before.select("vkey").distinct(), "vkey", "left_anti")
    again = again.withColumn("ord", F.col("ord") + shift).withColumn("score", F.col("score") + REQUEUE_PENALTY)
    return queue.unionByName(again)


def requeued_left(queue: DataFrame, requeued: DataFrame) -> DataFrame:
    return queue.join(requeued.select("vkey").distinct(), "vkey", "left_semi").agg(F.count("*").alias("left"))
